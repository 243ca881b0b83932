"""Substring search by an index of short pieces.

The index holds the distinct ``(type, value)`` of the features as a dictionary, the pieces of one, two
and three characters of each value, and which documents have it. A condition is looked up by the
rarest piece of its term, in the values that hold it; only those are compared with the whole
pattern. No condition reads the features, and equal conditions of many queries are looked up once.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SPACE
from .joins import salted_join
from .numbering import numbered

#: Characters of the longest pieces.
LONGEST = 3


class SubstringIndex(NamedTuple):
    dictionary: DataFrame  # vid, type, value
    pieces: DataFrame  # type, piece, vid: lower-cased pieces of each value, once
    spread: DataFrame  # type, piece, n: how many values hold a piece
    holders: DataFrame  # vid, id


def _pieces(text: Column, size: int) -> Column:
    """Distinct pieces of ``size`` characters."""
    last = F.length(text) - size + 1
    places = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda k: F.substr(text, k, F.lit(size))))


def substring_index(features: DataFrame) -> SubstringIndex:
    """Index of features ``id, type, value``; null values are left out. `write_substring_index` stores it."""
    rows = features.select("id", "type", "value").filter("type is not null and value is not null").distinct()
    dictionary = numbered(rows.select("type", "value").distinct(), ["type", "value"], "vid").select("vid", "type", "value")
    lower = F.lower("value")
    every = F.concat(*(_pieces(lower, size) for size in range(1, LONGEST + 1)))
    pieces = dictionary.select("type", F.explode(every).alias("piece"), "vid")
    spread = pieces.groupBy("type", "piece").agg(F.count("*").alias("n"))
    named = rows.select(F.struct("type", "value").alias("named"), "id")
    numbers = dictionary.select(F.struct("type", "value").alias("named"), "vid")
    return SubstringIndex(dictionary, pieces, spread, salted_join(named, numbers, "named").select("vid", "id"))


def write_substring_index(index: SubstringIndex, path: str) -> None:
    """Store an index, each table in the order it is asked in."""
    spark = index.dictionary.sparkSession
    index.dictionary.write.parquet(f"{path}/dictionary")
    index = index._replace(dictionary=spark.read.parquet(f"{path}/dictionary"))
    index.pieces.repartitionByRange("piece", "type", "vid").sortWithinPartitions("piece", "type", "vid").write.parquet(f"{path}/pieces")
    spark.read.parquet(f"{path}/pieces").groupBy("type", "piece").agg(F.count("*").alias("n")).write.parquet(f"{path}/spread")
    index.holders.repartitionByRange("vid", "id").sortWithinPartitions("vid", "id").write.parquet(f"{path}/holders")


def read_substring_index(spark: SparkSession, path: str) -> SubstringIndex:
    return SubstringIndex(*(spark.read.parquet(f"{path}/{name}") for name in SubstringIndex._fields))


def conditions(queries: DataFrame) -> DataFrame:
    """``qid, type, term``: what each query (``qid, query``) asks of a document, once.

    A term asks for a title token and for a body token that hold it, ``@term`` only for the former.
    Terms are separated by whitespace of any kind; case does not matter.
    """
    words = F.filter(F.split(F.lower("query"), f"[{SPACE}]+"), lambda w: w != "")
    rows = queries.select("qid", F.explode(words).alias("word"))
    title = F.startswith("word", F.lit("@"))
    asked = F.when(title, F.array(F.struct(F.lit("title").alias("type"), F.expr("substring(word, 2)").alias("term")))).otherwise(
        F.array(*(F.struct(F.lit(t).alias("type"), F.col("word").alias("term")) for t in ("title", "body")))
    )
    return rows.select("qid", F.inline(asked)).distinct()


def _met(index: SubstringIndex, wanted: DataFrame) -> DataFrame:
    """``type, term, vid`` for every value that meets a condition of ``wanted`` (``type, term``)."""
    runs = F.filter(F.split("term", "[%_]"), lambda r: r != "")
    size = F.least(F.lit(LONGEST), F.length("run"))
    # Of each run of characters, its pieces of three, or itself if it is shorter.
    options = F.flatten(F.transform(runs, lambda r: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(r) - LONGEST + 1, F.lit(1))), lambda k: F.substr(r, k, F.lit(LONGEST)))))
    named = wanted.filter(F.size(runs) > 0).select("type", "term", F.explode(F.array_distinct(options)).alias("piece"))
    # A piece that no value holds counts as the rarest: nothing meets the condition.
    counted = named.join(index.spread, ["type", "piece"], "left").select("type", "term", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece").alias("p"))
    rarest = counted.groupBy("type", "term").agg(F.min("p").alias("p")).filter("p.n > 0").select("type", "term", "p.piece")
    candidates = index.pieces.join(rarest, ["type", "piece"]).select("type", "term", "vid")
    values = index.dictionary.select("vid", "value")
    pattern = F.concat(F.lit("%"), F.replace("term", F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    checked = candidates.join(values, "vid").filter(F.like(F.lower("value"), pattern)).select("type", "term", "vid")
    # Terms of wildcards only ask for a length: one character for each ``_``.
    length = F.length(F.replace("term", F.lit("%"), F.lit("")))
    bare = wanted.filter(F.size(runs) == 0).select("type", "term", length.alias("length"))
    lengths = index.dictionary.select("type", "vid", F.explode(F.sequence(F.lit(0), F.length(F.lower("value")))).alias("length"))
    return checked.unionByName(lengths.join(bare, ["type", "length"]).select("type", "term", "vid"))


def search_substrings(index: SubstringIndex, queries: DataFrame) -> DataFrame:
    """``(qid, id)`` of the documents that meet all conditions of a query (``qid, query``).

    ``%`` and ``_`` are wildcards, a backslash is itself. Queries of blanks give no rows, as do null
    ones. A document meets a condition through any number of values and counts once for it.
    """
    asked = conditions(queries)
    met = _met(index, asked.select("type", "term").distinct())
    needed = asked.groupBy("qid").agg(F.count("*").alias("needed"))
    ids = met.join(index.holders, "vid").select("type", "term", "id").distinct()
    found = ids.join(asked, ["type", "term"]).groupBy("qid", "id").agg(F.count("*").alias("met"))
    return found.join(needed, "qid").filter("met = needed").select("qid", "id")
