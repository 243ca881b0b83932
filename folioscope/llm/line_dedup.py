"""Line dedup by overlapping windows of three lines.

Every three consecutive lines that are not blank make a window. Of the windows with the same
content in the whole corpus the first stays, by ``doc_id`` and then by line; each later one covers
its three lines, and the covered lines of all windows together are removed. Copies overlap as they
may: in a run of equal lines every window but the first covers its lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import known, text_key

SIZE = 3


def _lined(docs: DataFrame) -> DataFrame:
    """Adds ``_lines`` and ``_at``: the places, from 0, of the lines that are not blank."""
    lined = docs.withColumn("_lines", F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n"))
    places = F.filter(F.transform("_lines", lambda x, i: F.when(F.rlike(x, F.lit(r"[^ \t\r\f\x0b]")), i)), lambda i: i.isNotNull())
    return lined.withColumn("_at", places)


def repeated_windows(docs: DataFrame) -> DataFrame:
    """The later occurrences: ``doc`` and ``row`` (id, null as the smallest, and hash of the text), ``at`` (window number in the document)."""
    lined = _lined(docs.select(known(F.col("doc_id").cast("long")).alias("doc"), text_key().alias("row"), "text")).where(F.size("_at") >= SIZE)
    lines = [F.get("_lines", F.get("_at", F.col("i") + k)) for k in range(SIZE)]
    starts = lined.select("doc", "row", "_lines", "_at", F.explode(F.sequence(F.lit(0), F.size("_at") - SIZE)).alias("i"))
    windows = starts.select("doc", "row", F.col("i").alias("at"), F.xxhash64(*lines).alias("h"), F.xxhash64(F.lit(1), *reversed(lines)).alias("g"))
    place = F.struct("doc", "row", "at")
    first = windows.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    first = first.where("first <> last").select("h", "g", "first")
    return windows.join(first, ["h", "g"]).where(place != F.col("first")).select("doc", "row", "at")


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` less its removed lines, and ``n_lines`` and ``n_removed``.

    Needs ``doc_id`` and ``text``; all columns stay as they are, but ``n_lines`` (lines that are
    not blank) and ``n_removed`` replace any of those names. Blank lines stay. Documents of fewer
    than three lines have no window and stay whole; a null text stays null. Rows that share an id, or
    have none, are documents of their own, null ids first and then by a hash of the text; rows equal
    in id and text count as one document, none of them a repetition of another.

    Windows travel as two hashes of 64 bits with their place; the text is shuffled once, to meet
    the numbers of its repeated windows, of which a document holds at most as many as lines.
    """
    covering = repeated_windows(docs).groupBy(F.col("doc").alias("_doc"), F.col("row").alias("_row")).agg(F.collect_set("at").alias("_windows"))
    own = docs.select(*(F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed")))
    joined = own.withColumn("_doc", known(F.col("doc_id").cast("long"))).withColumn("_row", text_key()).join(covering, ["_doc", "_row"], "left")
    lined = _lined(joined).withColumn("n_lines", F.size("_at").cast("long"))
    covered = F.array_distinct(F.flatten(F.transform("_windows", lambda k: F.slice("_at", k + 1, SIZE))))
    lined = lined.withColumn("_covered", F.coalesce(covered, F.array().cast("array<int>")))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_covered")
    lined = lined.withColumn("_left", F.when(F.size("_covered") > 0, left))
    text = F.when(F.col("_left").isNull(), F.col("text")).otherwise(F.array_join(F.transform("_left", lambda i: F.get("_lines", i)), "\n"))
    return lined.select(*(F.col(c) if c != "text" else text.alias("text") for c in own.columns), "n_lines", F.size("_covered").cast("long").alias("n_removed"))


def documents_left(docs: DataFrame) -> DataFrame:
    """`drop_repeated_lines`, without the documents that lost all their lines; ``n_chars`` follows the text."""
    done = drop_repeated_lines(docs).where("n_removed = 0 or n_removed < n_lines")
    if "n_chars" in docs.columns:
        size = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        done = done.withColumn("n_chars", size)
    return done.select(*docs.columns)


