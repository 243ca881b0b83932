"""Reading encyclopedia dumps in XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.entities import blank_nbsp
from ..operators.articles import in_main_namespace, without_redirect_element
from .blocks import row_place

PAGE_SCHEMA = (
    "id BIGINT, ns INT, title STRING, redirect STRUCT<_title: STRING>, "
    "revision STRUCT<id: BIGINT, timestamp: STRING, text: STRING>, _corrupt STRING"
)
XML_OPTIONS = {
    "rowTag": "page",
    "ignoreSurroundingSpaces": "false",  # trimming would shift link positions
    "ignoreNamespace": "true",
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "_corrupt",
}


def _flat(pages: DataFrame, bad: str) -> DataFrame:
    if bad not in ("fail", "keep", "drop"):
        raise ValueError(f"bad must be fail, keep or drop, not {bad}")
    text = F.nullif(F.col("revision.text"), F.lit(""))
    flat = pages.select(
        "id", "ns", "title",
        F.col("redirect._title").alias("redirect"),
        F.col("revision.id").alias("rid"),
        F.try_to_timestamp("revision.timestamp").alias("date"),
        text.alias("text"),
        "_corrupt",
        *(c for c in pages.columns if c == "place"),
    )
    if bad == "keep":
        return flat
    readable = F.col("_corrupt").isNull()
    if bad == "fail":
        stop = F.raise_error(F.concat(F.lit("a page could not be read: "), F.substr("_corrupt", F.lit(1), F.lit(300))))
        readable = F.when(readable, True).otherwise(stop.cast("boolean"))
    return flat.filter(readable).drop("_corrupt")


def scan_dump(
    spark: SparkSession, path: str, many_files: bool = False, namespace: int | None = None,
    bad: str = "fail", place: bool = False,
) -> DataFrame:
    """Dump pages ``id, ns, title, redirect, rid, date, text``; an empty text is null.

    The default splits large files: records end at ``</page>``, which cannot occur inside text,
    so every task parses its own range of the file. ``many_files`` uses the XML reader, which
    takes one task per file. ``namespace`` drops other pages before they are parsed.

    ``bad`` says what a page that can't be read does: ``fail`` ends the job, ``keep`` returns it with
    its text in ``_corrupt``, ``drop`` leaves it out. ``place`` adds where in the dump a page stands, for
    `limit_in_order`.
    """
    if many_files:
        pages = spark.read.format("xml").options(**XML_OPTIONS).schema(PAGE_SCHEMA).load(path)
        if place:
            pages = pages.withColumn("place", row_place())
        if namespace is not None:
            pages = pages.filter(F.col("ns") == namespace)
        return _flat(pages, bad)
    chunks = spark.read.option("lineSep", "</page>").text(path)
    if place:
        chunks = chunks.withColumn("place", row_place())
    where = ["place"] if place else []
    start = F.regexp_instr("value", F.lit(r"<page[\s>]"))
    chunks = chunks.filter(start > 0)
    if namespace is not None:
        chunks = chunks.filter(F.contains("value", F.lit(f"<ns>{namespace}</ns>")))
    record = F.concat(F.substr("value", start), F.lit("</page>"))
    parsed = chunks.select(F.from_xml(record, PAGE_SCHEMA, XML_OPTIONS).alias("page"), *where).select("page.*", *where)
    return _flat(parsed, bad)


def scan_dump_raw(spark: SparkSession, path: str, many_files: bool = False, bad: str = "fail", place: bool = False) -> DataFrame:
    """Articles of a dump with one layer of entities decoded and no-break spaces as blanks; ``bad`` and ``place`` as for `scan_dump`."""
    pages = without_redirect_element(in_main_namespace(scan_dump(spark, path, many_files, namespace=0, bad=bad, place=place)))
    return pages.withColumns({"title": blank_nbsp(F.col("title")), "text": blank_nbsp(F.col("text"))})


def page_xml(pages: DataFrame, id_tag: Column | None = None) -> DataFrame:
    """One ``value`` line of XML per page, for writing dumps; ``id_tag`` is written for ``<id>``, to make flawed ones."""

    def escaped(c):
        for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(plain), F.lit(entity))
        return c

    redirect = F.when(
        F.col("redirect").isNotNull(), F.concat(F.lit('<redirect title="'), escaped(F.col("redirect")), F.lit('" />'))
    ).otherwise("")
    date = F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    value = F.concat(
        F.lit("<page><title>"), escaped(F.col("title")), F.lit("</title><ns>"), F.col("ns").cast("string"),
        F.lit("</ns>"), F.lit("<id>") if id_tag is None else id_tag, F.col("id").cast("string"), F.lit("</id>"), redirect,
        F.lit("<revision><id>"), F.col("rid").cast("string"), F.lit("</id><timestamp>"), date,
        F.lit('</timestamp><text xml:space="preserve">'), escaped(F.coalesce("text", F.lit(""))),
        F.lit("</text></revision></page>"),
    )
    return pages.select(value.alias("value"))
