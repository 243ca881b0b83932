"""Conversations from reply trees: root-to-leaf paths, ranked, each formatted as one text.

The template writes a turn as ``<turn>role<text>words</turn>`` and a line break. Inside roles and
texts three characters are escaped, so that no text can open or close a turn: a backslash becomes
``\\b``, ``<`` becomes ``\\l`` and ``>`` becomes ``\\g``. Every backslash of a formatted text starts
one of these three, which makes the way back exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stage

OPEN, MIDDLE, CLOSE = "<turn>", "<text>", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def linear_tree(conversations: DataFrame) -> DataFrame:
    """Rows by turn as a tree with one branch: each row answers the row before.

    Input: ``conv_id, turn, role, text``. Rows of equal turn are ordered by role and text; repeated
    rows stay; a null turn comes first; null role and text are empty; a null ``conv_id`` is a
    conversation of its own. Output: ``conv_id, node, parent, role, text, score``.
    """
    filled = conversations.select(
        "conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    )
    node = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")).cast("long")
    return filled.select("conv_id", node.alias("node"), "role", "text").select(
        "conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )


def paths(messages: DataFrame, best: int | None = None) -> DataFrame:
    """Every root-to-leaf path of every tree: ``conv_id, path, rank, position, node``.

    ``messages`` has ``conv_id, node, parent, score``. A parent that is null or not among the rows
    of its conversation makes a root. ``path`` is the leaf's node, ``rank`` orders the paths of a
    conversation by falling mean score (null counts as 0), then by leaf, and ``best`` keeps that
    many of them. Rows that repeat a node count once, with their highest score and smallest
    parent. Rows whose parents lead round in a circle have no leaf and no path; a leaf that hangs on
    a circle is an error.

    Each round of self-joins doubles the distance covered: the rows that hold a leaf's ancestors up
    to 2^k steps are joined with the pointers 2^k steps up, so a tree of depth n takes log2(n)
    rounds. Rows hold ids only; the texts are joined afterwards.
    """
    nodes = messages.groupBy("conv_id", "node").agg(F.min("parent").alias("parent"), F.max(F.coalesce("score", F.lit(0.0))).alias("score"))
    nodes = stage(nodes.select(F.coalesce("conv_id", F.lit(-(2**63))).alias("conv"), "node", "parent", "score"), "tree")
    inner = nodes.where("parent is not null").select("conv", F.col("parent").alias("node")).distinct()
    up = nodes.alias("n").join(nodes.select("conv", F.col("node").alias("parent")), ["conv", "parent"]).select("conv", "node", F.col("parent").alias("above"))
    reached = nodes.join(inner, ["conv", "node"], "left_anti").select("conv", F.col("node").alias("path"), "node", F.lit(0).cast("long").alias("up"))
    step, up, most = 1, stage(up, "up"), nodes.count()
    while not up.isEmpty():
        if step > most:
            raise ValueError("a parent chain leads round in a circle")
        further = reached.join(up, ["conv", "node"]).select("conv", "path", F.col("above").alias("node"), (F.col("up") + step).alias("up"))
        reached = stage(reached.unionByName(further), "reached")
        next_up = up.join(up.select("conv", F.col("node").alias("above"), F.col("above").alias("next")), ["conv", "above"])
        up = stage(next_up.where("node <> next").select("conv", "node", F.col("next").alias("above")), "up")
        step *= 2
    scored = reached.join(nodes.select("conv", "node", "score"), ["conv", "node"])
    total = scored.groupBy("conv", "path").agg(F.avg("score").alias("mean"), F.max("up").alias("depth"))
    ranked = total.withColumn("rank", F.row_number().over(W.partitionBy("conv").orderBy(F.desc("mean"), "path")))
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
    joined = reached.join(ranked.select("conv", "path", "rank", "depth"), ["conv", "path"])
    conv = F.when(F.col("conv") != -(2**63), F.col("conv")).alias("conv_id")
    return joined.select(conv, "path", "rank", (F.col("depth") - F.col("up")).alias("position"), "node")


def format_paths(messages: DataFrame, best: int | None = None, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per chosen path: ``conv_id, path, rank, formatted, loss_spans``.

    ``loss_spans`` lists ``start`` and ``size``, in code points of ``formatted``, of the texts of
    the roles ``trained``. Messages as for `paths`, with ``role`` and ``text`` (null: empty).
    """
    texts = messages.select("conv_id", "node", *(escape(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in ("role", "text")))
    texts = texts.groupBy("conv_id", "node").agg(F.min(F.struct("role", "text")).alias("said")).select("conv_id", "node", "said.*")
    chosen = paths(messages, best)
    same = chosen["conv_id"].eqNullSafe(texts["conv_id"]) & (chosen["node"] == texts["node"])
    turns = chosen.join(texts, same).select(chosen["conv_id"], "path", "rank", "position", "role", "text")
    whole = F.concat(F.lit(OPEN), "role", F.lit(MIDDLE), "text", F.lit(CLOSE))
    order = W.partitionBy("conv_id", "path").orderBy("position").rowsBetween(W.unboundedPreceding, -1)
    turns = turns.withColumn("whole", whole).withColumn("before", F.coalesce(F.sum(F.length("whole")).over(order), F.lit(0)))
    start = F.col("before") + F.length("role") + len(OPEN) + len(MIDDLE)
    span = F.when(F.col("role").isin([*trained]), F.struct(start.alias("start"), F.length("text").cast("long").alias("size")))
    said = F.array_sort(F.collect_list(F.struct("position", "whole", span.alias("span"))))
    made = turns.groupBy("conv_id", "path", "rank").agg(said.alias("said"))
    return made.select(
        "conv_id", "path", "rank", F.array_join(F.col("said.whole"), "").alias("formatted"),
        F.filter("said.span", lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns of formatted paths: ``conv_id, path, rank, position, role, text, masked``.

    ``masked`` says that a loss span covers the turn's text exactly. The inverse of `format_paths`.
    """
    pieces = F.split("formatted", CLOSE)
    rows = formatted.select("conv_id", "path", "rank", F.posexplode(F.slice(pieces, 1, F.size(pieces) - 1)).alias("position", "piece"))
    order = W.partitionBy("conv_id", "path").orderBy("position").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("piece") + len(CLOSE)).over(order), F.lit(0))
    role = F.substring_index(F.expr(f"substring(piece, {len(OPEN) + 1})"), MIDDLE, 1)
    rows = rows.withColumn("before", before).withColumn("role", role).withColumn("skip", F.length("role") + len(OPEN) + len(MIDDLE))
    rows = rows.withColumn("text", F.expr("substring(piece, skip + 1)"))
    spans = formatted.select(F.col("conv_id").alias("c"), F.col("path").alias("p"), F.inline("loss_spans"))
    start = rows["before"] + rows["skip"] == spans["start"]
    same = rows["conv_id"].eqNullSafe(spans["c"]) & (rows["path"] == spans["p"]) & start & (F.length("text") == spans["size"])
    return rows.join(spans, same, "left").select(
        rows["conv_id"], "path", "rank", "position", unescape(F.col("role")).alias("role"), unescape(F.col("text")).alias("text"),
        F.col("start").isNotNull().alias("masked"),
    )
