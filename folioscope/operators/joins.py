"""Joins for one very frequent key, and broadcasts behind a size check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import PART, stage

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
ROWS_PER_SLOT = 5_000_000
# Spark prunes row_number() <= k before the shuffle up to this k
# (spark.sql.optimizer.windowGroupLimitThreshold).
PRUNED_RANK = 1_000


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a count shows ``df`` within both bounds; it stops counting past the first."""
    width = sum(
        (F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16 for c in df.columns),
        F.lit(0),
    )
    row = (
        df.select(width.cast("long").alias("w"))
        .limit(max_rows + 1)
        .agg(F.count("*").alias("n"), F.sum("w").alias("b"))
        .first()
    )
    return row["n"] <= max_rows and (row["b"] or 0) <= max_bytes


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Mark ``df`` for broadcast if it is small, else leave the join to Spark."""
    return F.broadcast(df) if is_small(df) else df


def salted_join(
    big: DataFrame,
    small: DataFrame,
    key: str,
    how: str = "inner",
    rows_per_slot: int = ROWS_PER_SLOT,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Equi-join on ``key`` (present on both sides) with very frequent keys of ``big`` split.

    A key with more than ``rows_per_slot`` rows in ``big`` is spread over as many slots as it
    needs; the matching rows of ``small`` are repeated once per slot. ``how`` may be inner, left,
    left_semi or left_anti: each row of ``big`` meets all its matches in its one slot.

    The list of such keys has at most ``rows(big) / rows_per_slot`` entries. It is found and staged
    when the join is set up, so both sides and every retry use the same list, and without such keys
    the join is a plain one. ``big`` is read for it, so it should be a stored table; ``counts``
    (key, ``rows``) is for callers that have, or can get more cheaply, how often keys occur.
    """
    if counts is None:
        counts = big.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows"))
    slots = F.ceil(F.col("rows") / rows_per_slot).cast("int").alias("__slots")
    heavy = stage(counts.filter(F.col("rows") > rows_per_slot).select(key, slots), "heavy-keys")
    if heavy.isEmpty():
        return big.join(small, key, how)
    heavy = F.broadcast(heavy)
    rest = [F.col(f"`{c}`") for c in big.columns]
    left = big.join(heavy, key, "left").withColumn(
        "__slot",
        F.when(F.col("__slots") > 1, F.pmod(F.xxhash64(*rest), F.col("__slots")).cast("int")).otherwise(0),
    )
    right = small.join(heavy, key, "left").withColumn(
        "__slot", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__slots"), F.lit(1)) - 1))
    )
    return left.drop("__slots").join(right.drop("__slots"), [key, "__slot"], how).drop("__slot")


def looked_up(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows``, which lie in parts, joined with ``table`` on ``key``; ``how`` may be inner or left.

    Each part asks for its distinct keys and gets the answers back, so ``rows`` stay where they are and a key that is
    very frequent is asked for once a part. To be run within `parts_kept`.
    """
    answers = rows.select(PART, key).distinct().join(table, key)
    return rows.join(answers.hint("shuffle_hash"), [PART, key], how)


def top_per_group(
    df: DataFrame, group: list[str], order: list[Column], size: int, base: int = 0, slots: int = 64
) -> DataFrame:
    """Rows ``base + 1`` to ``base + size`` of each group in ``order``, with their ``rank``.

    ``order`` must be total. Small ranks are pruned by Spark ahead of the shuffle; for deep pages
    each group is first cut in ``slots`` parts, so no task sorts a whole large group.
    """
    last = base + size
    if last > PRUNED_RANK:
        part = W.partitionBy(*group, "__slot").orderBy(*order)
        df = (
            df.withColumn("__slot", F.pmod(F.xxhash64(*df.columns), F.lit(slots)))
            .withColumn("__rank", F.row_number().over(part))
            .filter(F.col("__rank") <= last)
            .drop("__slot", "__rank")
        )
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    return ranked.filter((F.col("rank") <= last) & (F.col("rank") > base))
