"""Session set-up and the shared folder that jobs stage tables in."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column that names the part a row of `in_parts` lies in, and the rows of a part.
PART, PART_ROWS = "__part", 1 << 20

_own_dirs: dict[str, str] = {}


def build_session(name: str, master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; ``master`` only for local runs."""
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A temporary folder stands in for it only in local mode, where all tasks run on one machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = tempfile.mkdtemp(prefix="folioscope-")
    return _own_dirs[context.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other job uses."""
    return f"{shared_dir(spark)}/folioscope/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return a scan of it.

    Cuts the lineage in a way that survives lost executors, and computes ``df`` once. ``options`` are the writer's.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(
    df: DataFrame, *keys: str, name: str, buckets: int | None = None, change: Callable[[DataFrame], DataFrame] = lambda df: df
) -> tuple[DataFrame, Callable[[], None]]:
    """Stage ``df`` in buckets of ``keys``, one file each; joins and groupings on them read it without a shuffle.

    ``change`` is made once the rows are where their bucket is, as a grouping by ``keys`` and more.

    Also returns what takes the table's name out of the session's catalog when it is no longer read.
    There are as many buckets as shuffle partitions unless ``buckets`` says otherwise.
    """
    parts = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _in_buckets(change(df.repartition(parts, *keys)), parts, keys, name)


def _in_buckets(df: DataFrame, buckets: int, keys: tuple[str, ...], name: str, **options: str) -> tuple[DataFrame, Callable[[], None]]:
    spark = df.sparkSession
    path = fresh_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(buckets, *keys).options(path=path, **options).saveAsTable(table)
    return spark.table(table), lambda: spark.sql(f"DROP TABLE IF EXISTS {table}") and None


def in_parts(df: DataFrame, name: str, rows: int = PART_ROWS) -> DataFrame:
    """Stage ``df`` where its rows are, with a column `PART`: rows of one task, ``rows`` of them at most.

    A part lies whole in one bucket, so what is grouped by it, or joined with `parts_kept`, moves no row. A ``df`` that
    has the column keeps its parts.
    """
    if PART not in df.columns:
        df = df.withColumn(PART, F.expr(f"monotonically_increasing_id() div {rows}"))
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    staged, drop = _in_buckets(df, buckets, (PART,), name, compression="zstd")
    drop()  # the name only: the scan and its files stay
    return staged


@contextmanager
def _setting(spark: SparkSession, key: str, default: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, default)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def parts_kept(spark: SparkSession) -> AbstractContextManager[None]:
    """Joins that run meanwhile on `PART` and another column leave rows that lie in parts where they are."""
    return _setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "true", "false")


def sorted_groups(spark: SparkSession) -> AbstractContextManager[None]:
    """Groupings that run meanwhile on rows sorted by their keys go through them in that order, and sort none again."""
    return _setting(spark, "spark.sql.execution.replaceHashWithSortAgg", "false", "true")


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan with fewer tasks than there are cores; a large scan is left as it is.

    Rows are dealt by their hash: dealing them in turn would sort whole texts first.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, F.xxhash64(*df.columns)) if df.rdd.getNumPartitions() < cores else df
