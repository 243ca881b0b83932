"""The jobs a user runs: load articles and features, build the graph, tabulate words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import articles as art
from ..operators import graph as gr
from ..operators import ngrams as ng
from ..operators import search as se
from ..operators.block_index import BlockIndex, compact
from ..session import stage
from ..sources import sinks
from ..sources.blocks import first_rows
from ..sources.dump import scan_dump, scan_dump_raw
from ..sources.tables import scan_diffs, scan_month_counts, scan_stored_vocab, scan_table, scan_vocab


def load_articles(
    spark: SparkSession, dump: str, out: str, reset: bool = False, limit: int | None = None, raw: bool = False,
    rejects: str | None = None, by_id: bool = False,
) -> DataFrame:
    """Dump to ``article`` table. ``limit`` counts the articles that are kept, in dump order or, with ``by_id``, by id.

    A page that can't be read ends the job, or goes to the table ``rejects`` if that is named;
    `load_result` then counts both.
    """
    bad = "fail" if rejects is None else "drop"
    if rejects is not None:
        write_rejects(spark, dump, rejects, reset)
    place = _in_order(limit, by_id)
    if raw:
        rows = art.stored_rows(scan_dump_raw(spark, dump, bad=bad, place=place))
    else:
        rows = art.article_rows(scan_dump(spark, dump, namespace=0, bad=bad, place=place))
    sinks.write_articles(_limited(rows, limit, by_id), out, reset)
    return scan_table(spark, out)


def _in_order(limit: int | None, by_id: bool) -> bool:
    return limit is not None and not by_id


def _limited(rows: DataFrame, limit: int | None, by_id: bool) -> DataFrame:
    return first_rows(rows, limit) if _in_order(limit, by_id) else art.limit_rows(rows, limit)


def write_rejects(spark: SparkSession, dump: str, out: str, reset: bool = False) -> None:
    """The pages of a dump that can't be read, as ``record``."""
    rows = scan_dump(spark, dump, bad="keep").filter("_corrupt is not null").select(F.col("_corrupt").alias("record"))
    rows.write.mode("overwrite" if reset else "errorifexists").parquet(out)


def load_result(spark: SparkSession, stored: str, rejects: str) -> DataFrame:
    """One row ``stored, failed``: rows of a stored table and pages that could not be read."""
    failed = scan_table(spark, rejects).agg(F.count("*").alias("failed"))
    return scan_table(spark, stored).agg(F.count("*").alias("stored")).crossJoin(F.broadcast(failed))


def load_documents(spark: SparkSession, dump: str, out: str, limit: int | None = None, by_id: bool = False) -> None:
    """Dump to ``document`` and ``feature`` tables; ``limit`` and ``by_id`` as for `load_articles`."""
    documents = art.document_rows(scan_dump(spark, dump, place=_in_order(limit, by_id)))
    sinks.write_documents(_limited(documents, limit, by_id), out)


def build_graph(spark: SparkSession, dump: str, out: str, limit: int | None = None, by_id: bool = False) -> dict[str, DataFrame]:
    """Dump to the seven graph tables. ``limit`` counts pages of every kind, in dump order or, with ``by_id``, by id.

    The dump is parsed once. Tables are written in the order they depend on each other, and each
    step reads what the step before it stored.
    """
    pages = _limited(scan_dump(spark, dump, place=_in_order(limit, by_id)), limit, by_id)
    pages = stage(pages.withColumn("length", art.text_length(pages)), "dump-pages")

    def put(name: str, table: DataFrame) -> DataFrame:
        sinks.write_graph({name: table}, out)
        return scan_table(spark, f"{out}/{name}")

    tables = {
        "page": put("page", art.page_rows(pages)),
        "redirect": put("redirect", art.redirect_rows(pages)),
        "title_link": put("title_link", gr.extract_links(pages)),
    }
    tables["id_link"] = put("id_link", gr.join_link_ids(tables["title_link"], tables["page"]))
    tables["id_redirect"] = put("id_redirect", gr.join_redirect_ids(tables["redirect"], tables["page"]))
    tables["final_redirect"] = put("final_redirect", gr.redirect_closure(tables["id_redirect"]))
    tables["final_link"] = put("final_link", gr.join_final_links(tables["id_link"], tables["final_redirect"]))
    return tables


def rank_pages(spark: SparkSession, graph: str, out: str) -> DataFrame:
    """The stored ``final_link`` of a graph to converged ranks ``id, rank``."""
    gr.page_rank(scan_table(spark, f"{graph}/final_link")).write.parquet(out)
    return scan_table(spark, out)


def index_articles(spark: SparkSession, articles: str, out: str, fields: tuple[str, ...] = ("title", "text")) -> dict[str, BlockIndex]:
    """Stored articles to a stored search index for each field."""
    rows = scan_table(spark, articles)
    for field in fields:
        se.write_index(se.field_index(rows, field), f"{out}/{field}")
    return {field: se.read_index(spark, f"{out}/{field}") for field in fields}


def insert_articles(spark: SparkSession, dump: str, articles: str, index: str, fields: tuple[str, ...] = ("title", "text")) -> None:
    """Add the articles of a further dump to stored articles and to the indexes of their fields."""
    rows = stage(art.article_rows(scan_dump(spark, dump, namespace=0)), "batch")
    sinks.append_rows(rows, articles)
    for field in fields:
        se.insert_into_index(se.field_index(rows, field), f"{index}/{field}")


def delete_articles(spark: SparkSession, articles: str, ids: DataFrame, index: str, out: str, fields: tuple[str, ...] = ("title", "text")) -> DataFrame:
    """Stored articles without the ids ``aid``, as a new table; in the indexes of their fields they are marked."""
    for field in fields:
        se.delete_from_index(ids, f"{index}/{field}")
    sinks.rewrite_without(scan_table(spark, articles), ids, out, "aid")
    return scan_table(spark, out)


def compact_indexes(spark: SparkSession, index: str, fields: tuple[str, ...] = ("title", "text")) -> None:
    """Put the segments that inserts and deletes have left into one, for each field."""
    for field in fields:
        compact(spark, f"{index}/{field}")


def insert_batch(spark: SparkSession, dump: str, out: str) -> None:
    """Add the documents of a further dump, with their features, to stored ones."""
    sinks.insert_documents(stage(art.document_rows(scan_dump(spark, dump)), "batch"), out)


def delete_documents(spark: SparkSession, stored: str, ids: DataFrame, out: str) -> None:
    """``document`` and ``feature`` tables without the given ids, as new tables."""
    for name, layout in (("document", []), ("feature", ["type"])):
        art.delete_by_id(scan_table(spark, f"{stored}/{name}"), ids).write.partitionBy(*layout).parquet(f"{out}/{name}")


def export_series(spark: SparkSession, counts: str, tokens: list[str], out: str) -> DataFrame:
    """Counts that `tabulate_words` stored as CSV to the wide CSV series of ``tokens``; returns the long series."""
    vocab = scan_stored_vocab(spark, f"{counts}/vocabulary")
    request = spark.createDataFrame([(",".join(tokens),)], "tokens STRING")
    series = ng.token_series(scan_month_counts(spark, f"{counts}/freq"), vocab, request)
    sinks.export_series_csv(series, tokens, out)
    return series


def tabulate_words(spark: SparkSession, diffs: str, vocab: str, out: str, csv: bool = False) -> None:
    """Diff files and a vocabulary file to counts per month."""
    words = scan_vocab(spark, vocab)
    counts = stage(ng.month_token_count(scan_diffs(spark, diffs), words), "month-counts")
    sinks.write_month_counts(ng.dense_calendar(counts, words), words, out, csv)
