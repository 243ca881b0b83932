"""A stored index for ranked search that takes inserts and deletes, and searches that stop early.

Documents are ordered by length and cut into blocks of `BLOCK`. A posting row is a term in a block: the
documents that hold it, and ahead of them the highest count and the least length among them. From
those two follows an upper bound of what the term can add to a score in the block, whatever the
average length is by then. A search adds the bounds of its terms for each block, scores the most
promising blocks, and then only those whose bound reaches the worst of the best hits so far.

Folders of an index: ``postings`` (number, term, block, n, tf_most, len_least, entries), ``terms``
(df), ``size`` (docs, total) and ``deleted`` (id), each by segment, and ``log``, which names the
segments that count. An insert or a delete adds a segment; sums of ``df``, ``docs`` and ``total`` over
the segments are those of the documents that are there, as a delete adds negative ones. Nothing that
is stored is written again but by `compact`. One writer at a time.
"""

from __future__ import annotations

import uuid
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import match_tokens
from ..session import sorted_groups, stage
from .joins import is_small, top_per_group

# The scoring constants of the usual ranked match, decimals kept.
K1, B = 1.2, 0.75
SCORE_DECIMALS = 6
#: Documents of a block, a power of two: its logarithm.
BLOCK_BITS = 7
# Up to this many distinct query terms are named in the filter of the index scan.
PUSHED_TERMS = 100
#: Up to this many queries a block is scored for all of them in the task that holds it.
TOGETHER = 1_000
#: Pairs of a query and a block for one task to score.
PAIRS = 8_192
#: If the queries are very many: blocks of a query that are looked up for its limit, and among how many they are chosen.
TRIED, CHOICE = 8, 64
#: Words of the texts that one task counts.
TASK_WORDS = 1 << 21

LOG = "number BIGINT, segment STRING, kind STRING"
ENTRY = "array<struct<id:bigint,tf:bigint,len:int>>"
SCHEMAS = {
    "postings": f"term STRING, block BIGINT, n BIGINT, tf_most BIGINT, len_least INT, entries {ENTRY}, segment STRING",
    "terms": "term STRING, df BIGINT, segment STRING",
    "size": "docs BIGINT, total BIGINT, repeats BIGINT, segment STRING",
    "deleted": "id BIGINT, segment STRING",
}


class BlockIndex(NamedTuple):
    """The live parts of a stored index; ``number`` is that of the segment."""

    postings: DataFrame  # number, term, block, n, tf_most, len_least, entries
    terms: DataFrame  # term, df; to be summed by term
    size: DataFrame  # one row: docs, avg; documents without terms do not count; repeats: 0 if no id is there twice
    deleted: DataFrame | None  # id, number: gone from all segments before that number


def part_score(tf: Column, length: Column, average: Column) -> Column:
    """What a term of weight one adds to a document's score. Rises with ``tf``, falls with ``length``."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def inverse_df(docs: Column, df: Column) -> Column:
    return F.ln(1 + (docs - df + 0.5) / (df + 0.5))


# Writing


def _log(spark: SparkSession, path: str, number: int, segment: str, kind: str) -> None:
    spark.createDataFrame([(number, segment, kind)], LOG).coalesce(1).write.mode("append").parquet(f"{path}/log")


def _segments(spark: SparkSession, path: str) -> list[tuple[int, str, str]]:
    """Number, folder and kind of the segments from the last base on; compaction keeps them few."""
    rows = sorted(tuple(r) for r in spark.read.schema(LOG).parquet(f"{path}/log").collect())
    base = max(n for n, (_, _, kind) in enumerate(rows) if kind == "base")
    return rows[base:]


def _put(df: DataFrame, path: str, name: str, segment: str) -> None:
    df.write.mode("append").parquet(f"{path}/{name}/segment={segment}")


def _places(lengths: DataFrame) -> DataFrame:
    """``id, place, block``; documents of like length share a block, which keeps its bound close to their scores."""
    ordered = lengths.select("id", F.col("len").cast("int").alias("len")).repartitionByRange("len", "id").sortWithinPartitions("len", "id")
    # A hash table of the places: what is joined with them is not sorted.
    places = ordered.select("id", F.monotonically_increasing_id().alias("place"))
    return places.withColumn("block", F.shiftright("place", BLOCK_BITS)).hint("shuffle_hash")


def _blocked(rows: DataFrame) -> DataFrame:
    """Posting rows of ``block, id, term, len, tf`` that are with their block. They are sorted once, for `sorted_groups`."""
    entry = F.struct("id", F.col("tf").cast("long").alias("tf"), F.col("len").cast("int").alias("len"))
    return rows.select("term", "block", entry.alias("entry")).sortWithinPartitions("term", "block").groupBy("term", "block").agg(
        F.count("*").alias("n"), F.max("entry.tf").alias("tf_most"), F.min("entry.len").alias("len_least"),
        F.sort_array(F.collect_list("entry")).alias("entries"),  # at most a block's documents
    )


def _blocked_texts(texts: DataFrame, lengths: DataFrame, tasks: int) -> DataFrame:
    """Texts move to the task of their id, for their place, and to that of their block, as texts: words are counted there."""
    met = texts.join(_places(lengths), "id").select("id", "text", "place", "block").repartition(tasks, "block")
    words = met.select("id", "place", "block", match_tokens(F.col("text")).alias("terms"))
    spread = words.select("id", "place", "block", F.size("terms").alias("len"), F.explode("terms").alias("term"))
    return _blocked(spread.groupBy("block", "place", "id", "len", "term").agg(F.count("*").alias("tf")))


def _write_segment(blocked: DataFrame, lengths: DataFrame, path: str, number: int, kind: str) -> None:
    """Store posting rows, and sums of the stored ``id, len`` of their documents, as a segment."""
    spark, segment = blocked.sparkSession, f"{number:06d}-{uuid.uuid4().hex}"
    with sorted_groups(spark):
        _put(blocked.sortWithinPartitions("term", "block"), path, "postings", segment)
    stored = spark.read.parquet(f"{path}/postings/segment={segment}")
    _put(stored.groupBy("term").agg(F.sum("n").alias("df")).sortWithinPartitions("term"), path, "terms", segment)
    held = lengths.filter("len > 0").groupBy("id").agg(F.count("*").alias("rows"), F.sum("len").alias("len"))
    repeats = F.count_if((F.col("rows") > 1) & F.col("id").isNotNull())
    total = F.coalesce(F.sum("len"), F.lit(0)).cast("long")
    size = held.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("docs"), total.alias("total"), repeats.alias("repeats"))
    _put(size, path, "size", segment)
    _log(spark, path, number, segment, kind)


def _write_texts(texts: DataFrame, path: str, number: int, kind: str) -> None:
    # Stored, as they are read for the order, for the sums and for the number of tasks.
    lengths = stage(texts.select("id", F.size(match_tokens(F.col("text"))).alias("len")), "lengths")
    words = lengths.agg(F.sum("len").alias("words")).first()["words"] or 0
    tasks = max(texts.sparkSession.sparkContext.defaultParallelism, -(-words // TASK_WORDS))
    _write_segment(_blocked_texts(texts, lengths, tasks), lengths, path, number, kind)


def create(texts: DataFrame, path: str) -> None:
    """Store a new index of ``texts`` (``id, text``); an error if there is one."""
    _write_texts(texts, path, 0, "base")


def insert(texts: DataFrame, path: str) -> None:
    """Add documents (``id, text``). An id that is there already must be deleted first, or it counts twice."""
    _write_texts(texts, path, _segments(texts.sparkSession, path)[-1][0] + 1, "insert")


def delete(ids: DataFrame, path: str) -> None:
    """Take out the documents of ``id``; ids that are not there, null and repeated ones are ignored.

    The postings are read once, for what the documents add to the sums. An id may be inserted again
    afterwards.
    """
    spark = ids.sparkSession
    index = read(spark, path)
    number = _segments(spark, path)[-1][0] + 1
    segment = f"{number:06d}-{uuid.uuid4().hex}"
    gone = ids.select(F.col("id").cast("long").alias("id")).filter("id is not null").distinct()
    held = stage(live_postings(index).join(gone, "id", "left_semi"), "deleted-postings")
    _put(held.groupBy("term").agg((-F.count("*")).alias("df")), path, "terms", segment)
    documents = held.select("number", "id", "len").distinct()
    _put(documents.agg((-F.count("*")).alias("docs"), (-F.coalesce(F.sum("len"), F.lit(0))).cast("long").alias("total"), F.lit(0).cast("long").alias("repeats")), path, "size", segment)
    _put(documents.select("id").distinct(), path, "deleted", segment)
    _log(spark, path, number, segment, "delete")


def compact(spark: SparkSession, path: str) -> None:
    """Put what is live into one new base segment. Searches read the old segments until it is logged."""
    index = read(spark, path)
    postings = stage(live_postings(index).drop("number"), "live-postings")
    lengths = stage(postings.select("id", "len").distinct(), "live-lengths")
    placed = postings.join(_places(lengths), "id").select("id", "term", "len", "tf", "block").repartition("block")
    _write_segment(_blocked(placed), lengths, path, _segments(spark, path)[-1][0] + 1, "base")


# Reading


def read(spark: SparkSession, path: str) -> BlockIndex:
    """The index as the log has it now; later inserts and deletes are not seen."""
    segments = _segments(spark, path)

    def part(name: str, kinds: tuple[str, ...]) -> DataFrame | None:
        whole = None
        for number, segment, kind in segments:
            if kind in kinds:
                schema = SCHEMAS[name].removesuffix(", segment STRING")
                rows = spark.read.schema(schema).parquet(f"{path}/{name}/segment={segment}").withColumn("number", F.lit(number).cast("long"))
                whole = rows if whole is None else whole.unionByName(rows)
        return whole

    every = ("base", "insert", "delete")
    docs = F.coalesce(F.sum("docs"), F.lit(0))
    # An id may be in two segments, or in an index that was stored without the count.
    held = sum(kind != "delete" for _, _, kind in segments)
    repeats = F.lit(1).cast("long") if held > 1 else F.sum(F.coalesce("repeats", F.lit(1)))
    size = part("size", every).agg(docs.alias("docs"), (F.sum("total") / F.nullif(docs, F.lit(0))).alias("avg"), repeats.alias("repeats"))
    deleted = part("deleted", ("delete",))
    if deleted is not None:
        deleted = deleted.groupBy("id").agg(F.max("number").alias("number"))
    return BlockIndex(part("postings", ("base", "insert")), part("terms", every).drop("number"), size, deleted)


def _without_deleted(rows: DataFrame, index: BlockIndex) -> DataFrame:
    """``rows`` (``number``, ``id``) without those that were deleted after their segment."""
    if index.deleted is None:
        return rows
    gone = index.deleted.select(F.col("id").alias("__gone"), F.col("number").alias("__until"))
    return rows.join(gone, (F.col("id") == F.col("__gone")) & (F.col("number") < F.col("__until")), "left_anti")


def live_postings(index: BlockIndex) -> DataFrame:
    """``number, id, term, len, tf`` of the documents that are there."""
    rows = index.postings.select("number", "term", F.inline("entries"))
    return _without_deleted(rows, index).select("number", "id", "term", "len", "tf")


# Searching


class _Search(NamedTuple):
    index: BlockIndex
    weights: DataFrame  # qid, term, weight
    few: bool  # weights may be broadcast
    together: bool  # the queries are so few that a block is scored for all of them at once
    repeats: bool  # an id may be in several blocks, and then has a score in each
    rows: DataFrame  # postings of the terms asked for
    average: Column


def _prepared(index: BlockIndex, asked: DataFrame) -> _Search:
    size = index.size.select(F.struct("docs", "avg")).scalar()
    found = asked.join(index.terms, "term").groupBy("qid", "term", "times").agg(F.sum("df").alias("df")).filter("df > 0")
    weights = stage(found.select("qid", "term", (inverse_df(size["docs"], F.col("df")) * F.col("times")).alias("weight")), "weights")
    few, rows = is_small(weights), index.postings
    together = few and weights.select("qid").distinct().limit(TOGETHER + 1).count() <= TOGETHER
    named = [r["term"] for r in weights.select("term").distinct().limit(PUSHED_TERMS + 1).collect()] if few else []
    if 0 < len(named) <= PUSHED_TERMS:
        rows = rows.filter(F.col("term").isin(*named))  # reaches the scan
    return _Search(index, weights, few, together, bool(index.size.first()["repeats"]), rows, size["avg"])


def _heads(search: _Search, weights: DataFrame | None = None, *more: str) -> DataFrame:
    """``qid, number, block, n, most``: a row for each term of a query in each block; reads no entries. ``more`` are columns of ``weights``."""
    heads, weights = search.rows.select("number", "term", "block", "n", "tf_most", "len_least"), search.weights if weights is None else weights
    joined = heads.join(F.broadcast(weights) if search.few else weights, "term")
    most = F.col("weight") * part_score(F.col("tf_most"), F.col("len_least"), search.average)
    return joined.select("qid", "number", "block", "n", most.alias("most"), *more)


def _scored(search: _Search, blocks: DataFrame) -> DataFrame:
    """``qid, id, score`` of the documents of ``blocks`` (``qid, number, block``) that share a term with the query."""
    part = F.col("weight") * part_score(F.col("tf"), F.col("len"), search.average)
    score = F.round(F.sum(part), SCORE_DECIMALS).alias("score")
    if not search.together:
        needed = blocks.select("qid", "number", "block").join(search.weights, "qid")
        found = search.rows.select("number", "term", "block", "entries").join(needed, ["number", "term", "block"])
        rows = _without_deleted(found.select("qid", "number", "weight", F.inline("entries")), search.index)
        return rows.groupBy("qid", "id").agg(score)
    # Postings move to the task of their block and are unfolded there for each query, so what is added up
    # is there already, unless an id is in several blocks.
    tasks = max(blocks.sparkSession.sparkContext.defaultParallelism, -(-blocks.count() // PAIRS))
    place = ["number", "block"]
    asked = blocks.select("qid", *place).repartition(tasks, *place).groupBy(*place).agg(F.collect_set("qid").alias("qids"))
    held = search.rows.select(*place, "term", "entries").join(F.broadcast(search.weights.select("term").distinct()), "term", "left_semi")
    places = blocks.select(*place).distinct()
    if is_small(places):  # postings of other blocks stay where they are
        held = held.join(F.broadcast(places), place, "left_semi")
    met = held.repartition(tasks, *place).join(asked.hint("shuffle_hash"), place)
    met = met.join(F.broadcast(search.weights), "term").filter(F.array_contains("qids", F.col("qid")))
    rows = met.select("qid", *place, "weight", F.inline("entries"))
    if search.repeats:
        return _without_deleted(rows, search.index).groupBy("qid", "id").agg(score)
    added = rows.groupBy("qid", *place, "id").agg(score)
    return _without_deleted(added, search.index).select("qid", "id", "score")


def _best(scored: DataFrame, size: int) -> DataFrame:
    return top_per_group(scored, ["qid"], [F.desc("score"), F.col("id")], size).drop("rank")


def _selected(search: _Search, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks scored at first, the best hits in them, and the other blocks that may hold a better one.

    Each block of a query holds a document that
    matches, so as many blocks as hits are asked for give that many hits, unless documents were deleted. A document of another block with the score of the
    last hit may come before it, so equal bounds stay, with room for the rounding of scores.
    """
    bounds = stage(_heads(search).groupBy("qid", "number", "block").agg(F.sum("most").alias("bound")), "bounds")
    first = stage(top_per_group(bounds, ["qid"], _by_bound(), size).select("qid", "number", "block"), "first-blocks")
    hits = stage(_best(_scored(search, first), size), "first-hits")
    others = bounds.join(first, ["qid", "number", "block"], "left_anti").join(_limits(hits, size), "qid", "left")
    reach = F.col("least").isNull() | (F.col("bound") >= F.col("least"))
    return first, hits, stage(others.filter(reach).select("qid", "number", "block"), "other-blocks")


def _by_bound() -> list[Column]:
    return [F.desc("bound"), F.col("number"), F.col("block")]


def _limits(hits: DataFrame, size: int) -> DataFrame:
    """``qid, least`` of the queries that have ``size`` hits: what a score has to reach to be among the best, with room for rounding."""
    limit = hits.groupBy("qid").agg(F.min("score").alias("least"), F.count("*").alias("hits"))
    return limit.filter(F.col("hits") >= size).select("qid", (F.col("least") - 10.0**-SCORE_DECIMALS).alias("least"))


# For very many queries, not each of their terms is looked up in each of its blocks: a term that they share,
# like a word of all titles, would meet all queries in all blocks, and all documents in them.


class _Reach(NamedTuple):
    first: DataFrame  # qid, number, block: looked up for the limit
    terms: DataFrame  # qid, term, weight, peak, needed, rest, least; see `_marked`
    blocks: DataFrame  # qid, number, block, bound, rest, least: what may hold a hit


def _peaks(search: _Search) -> DataFrame:
    """``weights`` with ``tf``, ``len`` and ``peak``: the most uses, the least length and what the term adds to a score at most, in any block."""
    known = search.rows.groupBy("term").agg(F.max("tf_most").alias("tf"), F.min("len_least").alias("len"), F.sum("n").alias("docs"))
    peak = F.col("weight") * part_score(F.col("tf"), F.col("len"), search.average)
    return search.weights.join(known, "term").select("qid", "term", "weight", "tf", "len", "docs", peak.alias("peak"))


def _leads(peaks: DataFrame, size: int) -> DataFrame:
    """The rarest terms of each query, as many as it takes for ``size`` documents."""
    before = W.partitionBy("qid").orderBy("docs", "term").rowsBetween(W.unboundedPreceding, -1)
    counted = peaks.withColumn("before", F.coalesce(F.sum("docs").over(before), F.lit(0)))
    return counted.filter(F.col("before") < size).select("qid", "term", "weight")


def _first_blocks(search: _Search, leads: DataFrame, size: int) -> DataFrame:
    """The best blocks of each query, by all its terms, among the best of its rarest terms; enough for ``size`` hits."""
    tried = max(size, TRIED)
    bounds = _heads(search, leads).groupBy("qid", "number", "block").agg(F.sum("most").alias("bound"))
    best = top_per_group(bounds, ["qid"], _by_bound(), max(size, CHOICE)).withColumn("of", F.count("*").over(W.partitionBy("qid")))
    best = stage(best.select("qid", "number", "block", "of"), "lead-blocks")
    asked = best.filter(F.col("of") > tried).join(search.weights, "qid")
    heads = search.rows.select("number", "term", "block", "tf_most", "len_least").join(asked, ["number", "term", "block"])
    most = F.sum(F.col("weight") * part_score(F.col("tf_most"), F.col("len_least"), search.average))
    chosen = top_per_group(heads.groupBy("qid", "number", "block").agg(most.alias("bound")), ["qid"], _by_bound(), tried)
    return best.filter(F.col("of") <= tried).select("qid", "number", "block").unionByName(chosen.select("qid", "number", "block"))


def _bound(terms: Column, average: Column) -> Column:
    """What ``terms`` (an array of weight, tf, len) add to a score at most.

    A document that holds ``s`` of them, one of them ``tf`` times, has ``s - 1 + tf`` words at least, so it can't hold many
    and have the score of a short one in each.
    """

    def of(s: Column) -> Column:
        caps = F.transform(terms, lambda t: t["weight"] * part_score(t["tf"], F.greatest(t["len"], s - 1 + t["tf"]), average))
        return F.aggregate(F.slice(F.sort_array(caps, False), F.lit(1), s), F.lit(0.0), lambda total, cap: total + cap)

    some = F.array_max(F.transform(F.sequence(F.lit(1), F.greatest(F.size(terms), F.lit(1))), of))
    return F.when(F.size(terms) > 0, some).otherwise(0.0)


def _marked(search: _Search, peaks: DataFrame, limit: DataFrame) -> DataFrame:
    """``qid, term, weight, peak, needed, rest, least``: whether a hit has to hold one of the query's terms like this.

    The most common terms, as long as all of them together stay below the limit, give no hit by themselves:
    they add ``rest`` at most to the score of a document that holds a needed one. Without a limit all are needed.
    """
    entry = F.struct("docs", "term", "weight", "peak", "tf", F.col("len").cast("long").alias("len"))
    terms = peaks.groupBy("qid").agg(F.sort_array(F.collect_list(entry), False).alias("terms")).join(limit, "qid", "left")
    terms = terms.withColumn("average", search.average)  # a lambda can't hold the query it comes from

    def halve(span: Column, _: Column) -> Column:
        middle = F.floor((span["low"] + span["high"] + 1) / 2).cast("int")
        below = _bound(F.slice(F.col("terms"), F.lit(1), middle), F.col("average")) < F.col("least")
        low = F.when(below, F.greatest(span["low"], middle)).otherwise(span["low"])
        return F.struct(low.alias("low"), F.when(below, span["high"]).otherwise(F.least(span["high"], F.greatest(middle - 1, low))).alias("high"))

    # All terms together reach any limit that a document has set.
    span = F.struct(F.lit(0).alias("low"), (F.size("terms") - 1).alias("high"))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size("terms"))).cast("int"))
    low = F.aggregate(steps, span, halve, lambda span: span["low"])
    # stored, so that it is computed once
    terms = stage(terms.withColumn("free", F.when(F.col("least").isNull() | (F.size("terms") == 1), 0).otherwise(low)), "query-terms")
    rest = F.when(F.col("free") > 0, _bound(F.slice("terms", F.lit(1), F.col("free")), F.col("average"))).otherwise(0.0)
    marked = terms.select("qid", "least", "free", rest.alias("rest"), F.posexplode("terms").alias("place", "t"))
    needed = F.col("place") >= F.col("free")
    return stage(marked.select("qid", "t.term", "t.weight", "t.peak", needed.alias("needed"), "rest", "least"), "marked-terms")


def _holding(search: _Search, blocks: DataFrame, terms: DataFrame, others: DataFrame) -> DataFrame:
    """``qid, id, score`` of the documents of ``blocks`` that hold one of ``terms`` (``qid, term, weight``), with what ``others`` add.

    Where ``blocks`` has ``bound``, ``rest`` and ``least``, a document goes on only if it may reach the limit. What others add is
    looked up by document, so a term that all documents of a block hold brings one row, not all of them.
    """
    part = F.col("weight") * part_score(F.col("tf"), F.col("len"), search.average)
    place = ["number", "block"]
    found = search.rows.join(blocks.join(terms, "qid"), ["number", "term", "block"])
    limits = [c for c in ("bound", "rest", "least") if c in blocks.columns]
    if limits:
        most = F.col("weight") * part_score(F.col("tf_most"), F.col("len_least"), search.average)
        found = found.withColumn("bound", F.col("bound") - most)
    rows = found.select("qid", *place, "weight", *limits, F.inline("entries"))
    if limits:
        rows = rows.filter(F.col("least").isNull() | (F.col("bound") + part >= F.col("least")))
    rows = _without_deleted(rows, search.index)
    held = rows.groupBy("qid", *place, "id").agg(F.sum(part).alias("part"), *(F.first(c).alias(c) for c in limits[1:]))
    if limits:
        held = held.filter(F.col("least").isNull() | (F.col("part") + F.col("rest") >= F.col("least")))
    held = stage(held.select("qid", *place, "id", "part"), "held")
    asked = held.select("qid", *place, F.col("id").alias("__id")).join(others, "qid")
    known = search.rows.join(others.select("term").distinct(), "term", "left_semi").select(*place, "term", F.inline("entries"))
    same = [F.col("id").eqNullSafe(F.col("__id")), *(known[c] == asked[c] for c in (*place, "term"))]
    more = known.join(asked, reduce(Column.__and__, same)).select("qid", "id", part.alias("part"))
    whole = held.select("qid", "id", "part").unionByName(more)
    return whole.groupBy("qid", "id").agg(F.round(F.sum("part"), SCORE_DECIMALS).alias("score"))


def _reach(search: _Search, size: int) -> _Reach:
    """The terms and the blocks that the best ``size`` hits of very many queries need."""
    peaks = stage(_peaks(search), "peaks")
    leads = stage(_leads(peaks, size), "lead-terms")
    first = stage(_first_blocks(search, leads, size), "first-blocks")
    others = search.weights.join(leads, ["qid", "term"], "left_anti")
    hits = _best(_holding(search, first, leads, others), size)
    terms = _marked(search, peaks, _limits(hits, size))
    needed = terms.filter("needed")
    total = needed.groupBy("qid").agg(F.sum("peak").alias("total"))
    needed = needed.join(total, "qid").withColumn("total", F.col("total") - F.col("peak") + F.col("rest"))
    heads = _heads(search, needed, "rest", "least", "total")
    heads = heads.filter(F.col("least").isNull() | (F.col("most") + F.col("total") >= F.col("least")))
    bounds = heads.groupBy("qid", "number", "block").agg(F.sum("most").alias("most"), F.max("rest").alias("rest"), F.max("least").alias("least"))
    bounds = bounds.select("qid", "number", "block", (F.col("most") + F.col("rest")).alias("bound"), "rest", "least")
    return _Reach(first, terms, stage(bounds.filter(F.col("least").isNull() | (F.col("bound") >= F.col("least"))), "reached-blocks"))


def best_hits(index: BlockIndex, asked: DataFrame, size: int) -> DataFrame:
    """``qid, id, score`` of the best ``size`` hits of each query, ties by id.

    ``asked`` is ``qid, term, times``. The score is the sum over query terms of
    ``ln(1 + (N - df + .5) / (df + .5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len / avg))``, kept to
    six decimals so that equal scores are equal.
    """
    search = _prepared(index, asked)
    if search.together or search.repeats:
        _, hits, others = _selected(search, size)
        return _best(hits.unionByName(_scored(search, others)), size)
    reach = _reach(search, size)
    needed, others = (reach.terms.filter(which).select("qid", "term", "weight") for which in ("needed", "not needed"))
    return _best(_holding(search, reach.blocks, needed, others), size)


def effort(index: BlockIndex, asked: DataFrame, size: int) -> DataFrame:
    """What `best_hits` reads: ``qid, postings`` (of the query's terms) and ``scored`` (those in blocks that are scored)."""
    search = _prepared(index, asked)
    if search.together or search.repeats:
        first, _, others = _selected(search, size)
    else:
        reach = _reach(search, size)
        first, others = reach.first, reach.blocks.select("qid", "number", "block")
    taken = first.unionByName(others).distinct().withColumn("taken", F.lit(True))
    heads = _heads(search).join(taken, ["qid", "number", "block"], "left")
    return heads.groupBy("qid").agg(F.sum("n").alias("postings"), F.sum(F.when(F.col("taken"), F.col("n")).otherwise(0)).alias("scored"))
