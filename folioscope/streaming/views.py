"""Browsing history fed by a stream of visit messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.history import RECENT, newest, view_rows
from ..sources.tables import VIEW_SCHEMA


def stream_views(
    messages: DataFrame, path: str, checkpoint: str, once: bool = False, strip_fragment: bool = False
) -> StreamingQuery:
    """Append the views of a message stream to the table at ``path``.

    ``once`` takes what is there and ends; otherwise the stream runs until it is stopped. Restarted
    with the same checkpoint it goes on where it was, each message stored once.
    """
    writer = (
        view_rows(messages, strip_fragment).writeStream.format("parquet")
        .outputMode("append").option("checkpointLocation", checkpoint)
    )
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def stream_recent_views(
    messages: DataFrame, path: str, checkpoint: str, n: int = RECENT, once: bool = False
) -> StreamingQuery:
    """Keep the newest ``n`` views of a message stream.

    Each batch merges with the table the batch before it left and writes its own, so a batch that
    is run again after a failure gives the same table. Older tables are removed once they are not
    needed for that: two are left at most. `read_recent` reads the last one.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kept = batch
        if batch_id > 0:
            before = spark.read.schema(VIEW_SCHEMA).parquet(_batch_path(path, batch_id - 1))
            kept = before.unionByName(batch)
        newest(kept, n).write.mode("overwrite").parquet(_batch_path(path, batch_id))
        for old in stored_batches(spark, path):
            # The batch before this one has been committed; only this one can run again.
            if old < batch_id - 1:
                _delete(spark, _batch_path(path, old))

    writer = view_rows(messages).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_recent(spark: SparkSession, path: str) -> DataFrame:
    """The newest views after the last batch whose table is complete; an error if there is none."""
    batches = stored_batches(spark, path)
    if not batches:
        raise ValueError(f"no batch has been stored at {path}")
    return spark.read.schema(VIEW_SCHEMA).parquet(_batch_path(path, max(batches)))


def stored_batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches with a complete table, at most three; lists one folder."""
    files, folder = _files(spark, path)
    if not files.exists(folder):
        return []
    found = [status.getPath() for status in files.listStatus(folder) if status.getPath().getName().startswith("batch=")]
    hadoop = spark._jvm.org.apache.hadoop.fs
    return sorted(int(p.getName().split("=")[1]) for p in found if files.exists(hadoop.Path(p, "_SUCCESS")))


def _batch_path(path: str, batch_id: int) -> str:
    return f"{path}/batch={batch_id}"


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _delete(spark: SparkSession, path: str) -> None:
    files, folder = _files(spark, path)
    files.delete(folder, True)
