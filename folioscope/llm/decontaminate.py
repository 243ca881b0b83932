"""Benchmark decontamination by winnowing.

The fingerprint of a text keeps, for every six consecutive k-grams of five words, the one with the
smallest hash. Two texts that share ten words in a row share six such k-grams, and so a kept hash:
no shared span of ten words or more is missed. Documents and benchmark items are joined on
fingerprints, and every hit is extended along its alignment to the whole run of equal words. Items
of fewer than ten words are fingerprinted whole.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import known, text_key, unknown

SPAN, GRAM = 10, 5
#: What bounds words: all of ASCII but digits and small letters.
BOUND = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    small = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(small, BOUND), lambda w: w != "")


def _grams(size: int) -> Column:
    """Hashes of all runs of ``size`` words of the column ``words``, in order."""
    at = F.sequence(F.lit(0), F.size("words") - size)
    grams = F.transform(at, lambda i: F.xxhash64(F.lit(size), *(F.get("words", i + k) for k in range(size))))
    return F.when(F.size("words") >= size, grams).otherwise(F.array().cast("array<bigint>"))


def _kept(span: int) -> Column:
    """The smallest hash of each window over the column ``grams``; nothing for a text shorter than ``span``."""
    width = span - GRAM + 1
    at = F.sequence(F.lit(0), F.size("grams") - width)
    kept = F.transform(at, lambda i: F.least(*(F.get("grams", i + k) for k in range(width))))
    return F.when(F.size("grams") >= width, F.array_distinct(kept)).otherwise(F.array().cast("array<bigint>"))


def _marked(texts: DataFrame, span: int, short: list[int]) -> DataFrame:
    """Adds ``marks``, the kept hashes of k-grams and the hashes of all runs of the sizes ``short``, to rows with ``words``."""
    marked = texts.withColumn("grams", _grams(GRAM)).withColumn("marks", _kept(span)).drop("grams")
    for size in short:
        marked = marked.withColumn("marks", F.concat("marks", F.array_distinct(_grams(size))))
    return marked


def _placed(texts: DataFrame, sizes: list[int], *keep: str) -> DataFrame:
    """``mark, at`` for every run of the given sizes."""
    pairs = [F.transform(_grams(size), lambda h, i: F.struct(h.alias("mark"), i.alias("at"))) for size in sizes]
    return texts.select(*keep, F.inline(F.concat(*pairs)))


def find_spans(docs: DataFrame, items: DataFrame, span: int = SPAN, doc: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Shared spans, and the words of every document.

    ``docs``: ``doc_id, text``; ``items``: ``item_id, text``. Returns ``doc, item_id, start, end``
    (in words of the document; ``doc`` has null ids as one) and ``doc, n_words``, a row for each
    row of ``docs``. ``doc`` may be given as an expression that tells rows of ``docs`` apart. A span is a maximal run of equal words of at least ``span`` words, or all
    words of a shorter item. Rows that share an id are judged as one document or item. Null and
    empty texts have no words and no spans; an item with a null id counts as an item.
    """
    if span < GRAM:
        raise ValueError(f"span must be {GRAM} or more")
    texts = items.select(known(F.col("item_id").cast("long")).alias("item_id"), words_of(F.col("text")).alias("words")).where("size(words) > 0")
    texts = stage(texts.withColumn("need", F.least(F.size("words"), F.lit(span))), "items")
    # at most span - 1 numbers
    short = sorted(r["need"] for r in texts.where(F.col("need") < span).select("need").distinct().collect())
    whole = _placed(texts.where(F.col("need") == span), [GRAM], "item_id", "need")
    long_marks = _marked(texts.where(F.col("need") == span), span, []).select("item_id", F.explode("marks").alias("mark"))
    item_marks = whole.join(long_marks, ["item_id", "mark"])
    for size in short:
        item_marks = item_marks.unionByName(_placed(texts.where(F.col("need") == size), [size], "item_id", "need"))
    item_marks = stage(item_marks.select("mark", "item_id", F.col("at").alias("item_at"), "need"), "item-marks")
    row = known(F.col("doc_id").cast("long")) if doc is None else doc
    read = docs.select(row.alias("doc"), words_of(F.col("text")).alias("words"))
    marked = stage(_marked(read, span, short).select("doc", F.size("words").cast("long").alias("n_words"), "marks"), "marks")
    meeting = marked.select("doc", F.explode("marks").alias("mark")).join(item_marks.select("mark").distinct(), "mark", "left_semi")
    suspects = docs.withColumn("doc", row).join(meeting.select("doc").distinct(), "doc", "left_semi")
    suspects = stage(suspects.select("doc", words_of(F.col("text")).alias("words")), "suspects")

    hits = _placed(suspects, [GRAM, *short], "doc").join(item_marks, "mark")
    lines = hits.select("doc", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    pairs = lines.join(suspects, "doc").select("doc", "item_id", "shift", F.col("words").alias("theirs"))
    first, size = F.greatest("shift", F.lit(0)), F.size("words")
    pairs = pairs.join(texts, "item_id").select("doc", "item_id", "need", first.alias("first"), "theirs", "words", "shift", size.alias("size"))
    n = F.least(F.size("theirs") - F.col("first"), F.col("size") - (F.col("first") - F.col("shift")))
    pairs = pairs.withColumn("n", n).where("n >= need")
    equal = F.zip_with(F.expr("slice(theirs, first + 1, n)"), F.expr("slice(words, first - shift + 1, n)"), lambda a, b: a == b)
    pairs = pairs.select("doc", "item_id", "need", "first", "n", equal.alias("equal"))
    breaks = F.filter(F.sequence(F.lit(-1), F.col("n")), lambda i: (i < 0) | (i == F.col("n")) | ~F.get("equal", i))
    pairs = pairs.select("doc", "item_id", "need", "first", breaks.alias("breaks"))
    runs = F.zip_with(
        F.expr("slice(breaks, 1, size(breaks) - 1)"), F.expr("slice(breaks, 2, size(breaks) - 1)"),
        lambda a, b: F.struct((F.col("first") + a + 1).alias("start"), (F.col("first") + b).alias("end")),
    )
    found = pairs.select("doc", "item_id", "need", F.inline(runs)).where(F.col("end") - F.col("start") >= F.col("need"))
    return found.select("doc", "item_id", "start", "end"), marked.select("doc", "n_words")


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_words, n_hit, items, contaminated``.

    ``n_hit`` counts the words inside any shared span, ``items`` lists the ids of the items with
    spans, sorted as strings (null ids: the smallest long). See `find_spans` for the cases.
    """
    spans, sizes = find_spans(docs, items, span)
    spans = stage(spans.distinct(), "spans")
    named = spans.groupBy("doc").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    parts = spans.select("doc", "start", "end").distinct().groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))

    def grow(state: Column, part: Column) -> Column:
        new = F.greatest(part["end"] - F.greatest(part["start"], state["reach"]), F.lit(0))
        return F.struct((state["n"] + new).alias("n"), F.greatest(state["reach"], part["end"]).alias("reach"))

    covered = parts.select("doc", F.aggregate("spans", begin, grow)["n"].cast("long").alias("n_hit"))
    joined = sizes.join(named, "doc", "left").join(covered, "doc", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        unknown("doc").alias("doc_id"), "n_words", n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, span: int = SPAN) -> DataFrame:
    """The documents without a shared span, all columns as they are.

    Rows that share an id, or have none, are judged each by its own text.
    """
    row = F.struct(known(F.col("doc_id").cast("long")), text_key())
    hit = find_spans(docs, items, span, row)[0].select(F.col("doc").alias("_row")).distinct()
    return docs.withColumn("_row", row).join(hit, "_row", "left_anti").select(*docs.columns)
