"""Work over the blocks that Spark cuts files into: rows in file order, records across line ends.

A block is known by its file, start and length. Two scans of the same files are cut alike; a row
whose block the other scan does not know ends the job, so no row is lost if they are not.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = ["file", "start", "length"]
EVERY_ROW = (1 << 63) - 1


def block_columns() -> list[Column]:
    """``file, start, length`` of the block a row of a file scan comes from."""
    names = {"file": "file_path", "start": "file_block_start", "length": "file_block_length"}
    return [F.col(f"_metadata.{source}").alias(name) for name, source in names.items()]


def row_place() -> Column:
    """Block and running number of a row of a file scan, for `first_rows`."""
    return F.struct(*block_columns(), F.monotonically_increasing_id().alias("seq"))


def _known(column: str) -> Column:
    stop = F.raise_error(F.lit("the blocks of a file changed between two scans"))
    return F.when(F.col(column).isNotNull(), True).otherwise(stop.cast("boolean"))


def first_rows(rows: DataFrame, n: int, place: str = "place") -> DataFrame:
    """The first ``n`` rows in the order of files by name and rows in them; drops the column ``place``.

    Rows are counted by block. Blocks before the one that the last row falls in are taken whole, later
    ones not at all; of that one block the numbers of its rows are sorted. Rows stay in their tasks.
    """
    at = rows.select(f"{place}.*")
    counts = at.groupBy(*BLOCK).agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(W.orderBy("file", "start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    quotas = counts.select(*BLOCK, F.greatest(F.least(F.lit(n) - before, F.col("rows")), F.lit(0)).alias("quota"), "rows")
    # One block at most is taken in part.
    edge = at.join(F.broadcast(quotas.filter("quota > 0 and quota < rows")), BLOCK)
    number = F.row_number().over(W.partitionBy(*BLOCK).orderBy("seq"))
    last = edge.withColumn("number", number).filter("number = quota").select(*BLOCK, F.col("seq").alias("last"))
    whole = F.when(F.col("quota") == F.col("rows"), F.lit(EVERY_ROW)).otherwise(F.lit(-1).cast("long"))
    limits = quotas.join(F.broadcast(last), BLOCK, "left").select(F.struct(*BLOCK).alias("__block"), F.coalesce("last", whole).alias("__last"))
    placed = rows.withColumn("__block", F.struct(*(F.col(f"{place}.{c}") for c in BLOCK)))
    joined = placed.join(F.broadcast(limits), "__block", "left")  # one row per block
    return joined.filter(_known("__last") & (F.col(f"{place}.seq") <= F.col("__last"))).drop("__block", "__last", place)


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """``record``: the records of CSV files whose quoted cells may hold line breaks, many tasks a file.

    A first pass counts the quotes of each block. Whether a block begins inside quotes follows from the
    quotes before it in its file, and then which of its line ends end a record. A record that goes over
    the end of a block is put together from its parts. Quotes inside cells are doubled, and stand only
    in cells that are quoted; lines end with a line feed, with or without a carriage return. Empty lines
    between records are dropped.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", *block_columns())
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counted = lines.groupBy(*BLOCK).agg(F.sum(quotes).alias("quotes"))
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    inside = counted.select(*BLOCK, (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    joined = lines.join(F.broadcast(inside), BLOCK, "left").filter(_known("inside"))  # one row per block

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, head, odd = None, [], False, False  # held: lines of a record that is not complete

        def piece() -> tuple:
            # 0: end of a record begun before this block, or all of the block; 1: begin of a record
            return (None, block[0], block[1], 0 if head else 1, "\n".join(held))

        for batch in batches:
            done, records = [], []
            values = batch.column("value")
            own = list(zip(*(batch.column(c).to_pylist() for c in BLOCK), batch.column("inside").to_pylist(), strict=True))
            odds = pc.bit_wise_and(pc.count_substring(values, '"'), 1).to_pylist()
            for value, here, turns in zip(values.to_pylist(), own, odds, strict=True):
                if block != here:
                    if held:
                        done.append(piece())
                    block, held, head, odd = here, [], here[3], here[3]
                held.append(value)
                odd ^= bool(turns)
                if not odd:
                    if head:
                        done.append(piece())
                    else:
                        records.append("\n".join(held))
                    held, head = [], False
            if records:
                none = pa.nulls(len(records))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(records, pa.string()), none.cast(pa.string()), none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.string())], names=NAMES
                )
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), TYPES, strict=True)], names=NAMES)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(piece(), TYPES, strict=True)], names=NAMES)

    NAMES = ["record", "file", "start", "kind", "piece"]
    TYPES = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string()]
    rows = joined.mapInArrow(cut, "record string, file string, start long, kind int, piece string")
    # At most two pieces a block.
    number = F.sum("kind").over(W.partitionBy("file").orderBy("start", "kind"))
    pieces = rows.filter("record is null").select("file", "start", "kind", "piece", number.alias("number"))
    parts = F.array_sort(F.collect_list(F.struct("start", "kind", "piece")))
    glued = pieces.groupBy("file", "number").agg(F.array_join(F.transform(parts, lambda p: p["piece"]), "\n").alias("record"))
    whole = rows.filter("record is not null").select("record").unionByName(glued.select("record"))
    return whole.select(F.regexp_replace("record", "\r(?=\n|\\z)", "").alias("record")).filter("record != ''")
