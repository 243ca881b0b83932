"""Writing tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import month_label
from ..operators.articles import delete_by_id, feature_rows
from ..operators.ngrams import series_pivot, token_total
from .tables import scan_month_counts


def write_documents(documents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``document`` and ``feature`` tables; features are laid out by type, as searches ask for it.

    Features are made from the stored documents, so the dump is read and decoded once.
    """
    documents.select("id", "title", "body").write.mode(mode).parquet(f"{path}/document")
    stored = documents.sparkSession.read.parquet(f"{path}/document")
    feature_rows(stored).write.mode(mode).partitionBy("type").parquet(f"{path}/feature")


def insert_documents(documents: DataFrame, path: str) -> None:
    """Add a batch of documents and their features to stored ones."""
    append_rows(documents.select("id", "title", "body"), f"{path}/document")
    feature_rows(documents).write.mode("append").partitionBy("type").parquet(f"{path}/feature")


def write_articles(articles: DataFrame, path: str, reset: bool = False) -> None:
    """Store articles; an existing table is an error unless it is to be reset."""
    articles.write.mode("overwrite" if reset else "errorifexists").parquet(path)


def append_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def rewrite_without(df: DataFrame, ids: DataFrame, path: str, key: str = "id") -> None:
    """Store ``df`` without the given ids as a new table."""
    delete_by_id(df, ids, key).write.parquet(path)


def write_graph(tables: dict[str, DataFrame], path: str) -> None:
    for name, table in tables.items():
        table.write.parquet(f"{path}/{name}")


def write_month_counts(dense: DataFrame, vocab: DataFrame, path: str, csv: bool = False) -> None:
    """``vocabulary``, ``freq_total`` and the counts by month, with zeros if the rows have them.

    As Parquet the counts are partitioned by month; as CSV each month is a folder ``freq_Y_M``. The
    totals are those of what was stored, so the counts are made once.
    """
    spark = vocab.sparkSession
    if not csv:
        vocab.write.parquet(f"{path}/vocabulary")
        dense.repartitionByRange("month", "idx").write.partitionBy("month").parquet(f"{path}/freq")
        token_total(spark.read.parquet(f"{path}/freq")).write.parquet(f"{path}/freq_total")
        return
    vocab.select("token", F.col("idx").alias("index")).write.csv(f"{path}/vocabulary", header=True, escape='"')
    labelled = dense.select(F.concat(F.lit("freq_"), month_label(F.col("month"))).alias("m"), F.col("idx").alias("token"), "count")
    labelled.repartitionByRange("m", "token").write.partitionBy("m").csv(f"{path}/freq", header=True)
    stored = scan_month_counts(spark, f"{path}/freq")
    token_total(stored).select(F.col("idx").alias("token"), "count").write.csv(f"{path}/freq_total", header=True)


def _decimals():
    def texts(values: pd.Series) -> pd.Series:
        return values.map(lambda x: "%.15f" % x, na_action="ignore")

    return F.pandas_udf(texts, "string")


def series_text(series: DataFrame, tokens: list[str]) -> DataFrame:
    """Wide series with 15 decimals, NaN as missing.

    Formatted in Python: Java rounds the shortest decimal form of a double and so differs in the
    last place. The table has one row per month.
    """
    decimals = _decimals()
    wide = series_pivot(series, tokens)
    return wide.select("date", *(decimals(F.col(f"`{t}`")).alias(t) for t in tokens))


def export_series_csv(series: DataFrame, tokens: list[str], path: str) -> None:
    """Wide series as CSV, one row per month in order; at most 189 rows, so one file."""
    series_text(series, tokens).coalesce(1).sortWithinPartitions("date").write.csv(path, header=True)
