"""From dump pages to articles, documents and features.

A dump page has the columns ``id, ns, title, redirect, rid, date, text``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.entities import unescape
from .joins import broadcast_if_small

# Title starts that are skipped, and body starts that mark a redirect. The first
# title start has no colon, so it also takes titles that merely begin with that word.
SKIPPED_TITLES = (
    "Wikipedia", "Talk:", "User:", "User talk:", "Category:", "Category talk:", "Template:", "File:",
)
REDIRECT_STARTS = ("#redirect", "#REDIRECT")

ARTICLE, REDIRECT, OTHER = 0, 1, 2


def _starts_with_any(c: Column, starts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for start in starts:
        found = found | F.startswith(c, F.lit(start))
    return found


def in_main_namespace(pages: DataFrame) -> DataFrame:
    return pages.filter("ns = 0")


def with_article_title(pages: DataFrame) -> DataFrame:
    """Drop talk, user, category, template and file pages by the start of their title."""
    return pages.filter(~_starts_with_any(F.col("title"), SKIPPED_TITLES))


def without_redirect_text(pages: DataFrame) -> DataFrame:
    """Drop bodies that start with one of the two redirect spellings; other spellings stay."""
    return pages.filter(~_starts_with_any(F.col("text"), REDIRECT_STARTS))


def without_redirect_element(pages: DataFrame) -> DataFrame:
    return pages.filter("redirect is null")


def with_body(pages: DataFrame) -> DataFrame:
    return pages.filter("text is not null")


def fill_default(df: DataFrame, *names: str, default: str = "") -> DataFrame:
    """Nulls in the named columns as ``default``."""
    return df.withColumns({n: F.coalesce(F.col(n), F.lit(default)) for n in names})


def page_kind() -> Column:
    """2 outside the main namespace, else 1 with a redirect element, else 0."""
    return F.when(F.col("ns") != 0, OTHER).when(F.col("redirect").isNotNull(), REDIRECT).otherwise(ARTICLE)


def classify_page(pages: DataFrame) -> DataFrame:
    return pages.withColumn("type", page_kind())


def text_length(pages: DataFrame) -> Column:
    """Length of the undecoded text; a stored ``length`` is used so that the text is not read."""
    return F.col("length") if "length" in pages.columns else F.length(F.coalesce("text", F.lit("")))


def page_rows(pages: DataFrame) -> DataFrame:
    """``page`` rows of articles and redirects; the length is of the text before decoding."""
    return in_main_namespace(pages).select(
        "id",
        F.col("rid").alias("rev"),
        "date",
        page_kind().alias("type"),
        text_length(pages).alias("length"),
        "title",
    )


def redirect_rows(pages: DataFrame) -> DataFrame:
    return (
        in_main_namespace(pages)
        .filter("redirect is not null")
        .select(F.col("title").alias("src"), F.col("redirect").alias("dst"))
    )


def _place(pages: DataFrame) -> list[str]:
    """Where a page stands in the dump, if the scan was asked for it."""
    return [c for c in pages.columns if c == "place"]


def article_rows(pages: DataFrame) -> DataFrame:
    """Search articles: main namespace, no redirect text."""
    return stored_rows(without_redirect_text(fill_default(in_main_namespace(pages), "text")))


def stored_rows(pages: DataFrame) -> DataFrame:
    """The columns of ``article``; empty text where the element was empty."""
    return fill_default(pages, "text").select(
        F.col("id").alias("aid"), "title", "rid", "date",
        tx.reduce_text(F.col("text")).alias("text"), F.col("text").alias("wiki"), *_place(pages),
    )


def document_rows(pages: DataFrame) -> DataFrame:
    """Documents ``id, title, body``; the body is decoded a second time."""
    kept = with_article_title(without_redirect_text(with_body(pages)))
    return kept.select("id", "title", unescape(F.col("text")).alias("body"), *_place(pages))


def document_tags(documents: DataFrame) -> DataFrame:
    """Title and body tokens of documents."""
    return documents.select(
        "id",
        tx.title_tokens(F.col("title")).alias("title_tags"),
        tx.body_tokens(F.col("body")).alias("body_tags"),
    )


def feature_rows(documents: DataFrame) -> DataFrame:
    """One bag of ``(id, type, value)`` rows from title and body tokens of documents.

    Both lists of a document are unfolded in the one scan, so the text is tokenised once.
    """
    tags = document_tags(documents)
    title = F.transform("title_tags", lambda v: F.struct(F.lit("title").alias("type"), v.alias("value")))
    body = F.transform("body_tags", lambda v: F.struct(F.lit("body").alias("type"), v.alias("value")))
    return tags.select("id", F.inline(F.concat(title, body)))


def union_tags(title_tags: DataFrame, body_tags: DataFrame) -> DataFrame:
    """The same bag from two tables of ``(id, value)``."""
    return title_tags.select("id", F.lit("title").alias("type"), "value").unionByName(
        body_tags.select("id", F.lit("body").alias("type"), "value")
    )


def limit_rows(df: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` rows by id, or all. The rows meet in one task: for short limits.

    `sources.blocks.first_rows` takes the first in dump order, any number of them.
    """
    return df if n is None else df.orderBy(df.columns[0]).limit(n)


def fetch(keys: DataFrame, docs: DataFrame, *columns: str, key: str = "id") -> DataFrame:
    """Look up ``columns`` for a table of ids; null where an id is unknown."""
    asked = keys.select(key).distinct()
    found = docs.select(key, *columns).join(broadcast_if_small(asked), key, "left_semi")
    return asked.join(found, key, "left")


def link_by_title(titles: DataFrame, docs: DataFrame, key: str = "id") -> DataFrame:
    """Exact title to the smallest id that bears it; null where no document does."""
    asked = titles.select("title").distinct()
    found = (
        docs.select("title", key)
        .join(broadcast_if_small(asked), "title", "left_semi")
        .groupBy("title")
        .agg(F.min(key).alias(key))
    )
    return asked.join(found, "title", "left")


def delete_by_id(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """``df`` without the rows of the given ids."""
    gone = ids.select(key).distinct()
    return df.join(broadcast_if_small(gone), key, "left_anti")


def kind_counts(pages: DataFrame) -> DataFrame:
    """Pages per kind, and in all under kind -1."""
    return classify_page(pages).rollup("type").count().select(
        F.coalesce("type", F.lit(-1)).alias("type"), F.col("count").alias("pages")
    )


def load_counts(pages: DataFrame) -> DataFrame:
    """Pages read, and records that did not parse (see ``scan_dump(bad="keep")``)."""
    return pages.agg(
        F.count_if(F.col("_corrupt").isNull()).alias("stored"),
        F.count_if(F.col("_corrupt").isNotNull()).alias("failed"),
    )
