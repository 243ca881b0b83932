"""Numbering the rows of a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stage

# monotonically_increasing_id() keeps the partition above this bit and the place in it below.
PLACE_BITS = 33


def numbered(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """Number the rows of ``df`` from 0 in the order of the columns ``order``.

    Rows are dealt to ranges and sorted there; each is numbered by the rows of the ranges before its
    own and its place. The sorted rows are staged, so that places and counts are of the same ranges.
    What meets in one task is one row per range. Rows that are equal in ``order`` are numbered in any
    order.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(sorted_rows.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", PLACE_BITS)
    place = F.col("__at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__rows"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"))
    joined = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return joined.select(*df.columns, (F.col("__offset") + place).alias(name))
