"""Reading stored tables, word-count CSV files and visit messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.calendar import label_month
from .blocks import quoted_records

VISIT_SCHEMA = "url STRING, timestamp DOUBLE"
VIEW_SCHEMA = "lang STRING, timestamp DOUBLE, title STRING"

# Cells that count as missing when a diff file is read.
MISSING_WORDS = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
DIFF_COLUMNS = ("c0", "c1", "time", "c3", "c4", "words")


def scan_table(spark: SparkSession, path: str) -> DataFrame:
    """A stored table; an error if there is none."""
    return spark.read.parquet(path)


def scan_diffs(spark: SparkSession, path: str, line_breaks: bool = True) -> DataFrame:
    """``time, words`` of headerless diff files; missing words are empty.

    Quoted words may hold line breaks. Large files are split in either case; files known to have no
    line breaks in quotes are read in one pass if ``line_breaks`` is false.
    """
    schema = ", ".join(f"{c} STRING" for c in DIFF_COLUMNS)
    if line_breaks:
        cells = F.from_csv("record", F.lit(schema), {"escape": '"', "maxCharsPerColumn": "-1"})
        rows = quoted_records(spark, path).select(cells.alias("row")).select("row.time", "row.words")
    else:
        rows = spark.read.schema(schema).options(escape='"').csv(path)
    words = F.when(F.col("words").isin(*MISSING_WORDS), "").otherwise(F.coalesce("words", F.lit("")))
    return rows.select("time", words.alias("words"))


def numbered_rows(df: DataFrame, name: str = "idx") -> DataFrame:
    """Number the rows of a file scan from 0 in file order.

    Rows are numbered inside each file block, and blocks are offset by the rows before them; only
    one row per block meets in one task.
    """
    block = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start")]
    rows = df.select("*", *block, F.monotonically_increasing_id().alias("__seq"))
    order = ["__file", "__start"]
    sizes = rows.groupBy(*order).agg(F.count("*").alias("__rows"))
    before = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*order, F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"))
    place = F.row_number().over(W.partitionBy(*order).orderBy("__seq")) - 1
    return (
        rows.withColumn("__place", place)
        .join(F.broadcast(offsets), order)
        .select(*df.columns, (F.col("__offset") + F.col("__place")).alias(name))
    )


def _plain_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    # emptyValue and nullValue off: tokens such as "nan" or "null" are words like any other.
    return spark.read.schema(schema).options(header=True, escape='"', enforceSchema=False).csv(path)


def scan_vocab(spark: SparkSession, path: str) -> DataFrame:
    """``token, idx`` of a vocabulary file with the one column ``index``; idx is the row number."""
    header = spark.read.options(header=True, escape='"').csv(path).columns
    schema = ", ".join(f"`{c}` STRING" for c in header)
    rows = numbered_rows(_plain_csv(spark, path, schema))
    return rows.select(F.col("index").alias("token"), "idx")


def scan_stored_vocab(spark: SparkSession, path: str) -> DataFrame:
    """``token, idx`` of a vocabulary as `sinks.write_month_counts` stores it."""
    return _plain_csv(spark, path, "token STRING, index BIGINT").select("token", F.col("index").alias("idx"))


def scan_month_counts(spark: SparkSession, path: str) -> DataFrame:
    """``month, idx, count`` of per-month CSV files, the month taken from the file name."""
    files = spark.read.schema("token BIGINT, count BIGINT").options(header=True, pathGlobFilter="*.csv", recursiveFileLookup=True)
    label = F.regexp_extract("_metadata.file_path", r"freq_(\d+_\d+)(?:\.csv|/)", 1)
    rows = files.csv(path).select(label.alias("label"), F.col("token").alias("idx"), "count")
    return rows.filter("label != ''").select(label_month(F.col("label")).alias("month"), "idx", "count")


def scan_view_events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Visit messages ``url, timestamp`` from JSON files, as a table or a stream."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(VISIT_SCHEMA).json(path)
