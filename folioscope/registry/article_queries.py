"""Dump scan, article filters and rows, documents, features and their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.entities import unescape
from ..operators import articles as art
from ..session import fresh_path
from ..sources import dump, sinks
from ..sources.blocks import first_rows
from ..sources.tables import scan_table
from .catalog import query
from .check_sql import (
    ARTICLE_TITLE, NO_REDIRECT_TEXT, SPACE, body_tokens, cap, decoded, feature_tokens, quoted, reduced,
)
from .derived import Inputs

STAMP = "%Y-%m-%d %H:%M:%S"
SQL_PAGE = f"select id, ns, title, redirect, rid, strftime(date, '{STAMP}') as date, nullif(text, '') as text from dump_page"
SQL_ARTICLE = f"select aid, title, rid, strftime(date, '{STAMP}') as date, text, wiki from search_article"
TEXT = "select doc_id, {} as out from documents"


def dated(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.date_format("date", "yyyy-MM-dd HH:mm:ss"))


def brief(df: DataFrame) -> DataFrame:
    return df.select("id", "ns", "title", F.md5("text").alias("text"))


def sql_brief(where: str) -> str:
    return f"select id, ns, title, md5(text) as text from dump_page where {where}"


# Scans and tables


@query("scan_dump", SQL_PAGE)
def _(i: Inputs):
    return dated(dump.scan_dump(i.spark, i.dump_file))


@query("scan_dump_raw", SQL_PAGE + " where ns = 0 and redirect is null")
def _(i: Inputs):
    return dated(dump.scan_dump_raw(i.spark, i.dump_file))


@query("load_counts", "select count(*) filter (id % 7 <> 0) as stored, count(*) filter (id % 7 = 0) as failed from dump_page")
def _(i: Inputs):
    path = fresh_path(i.spark, "flawed-xml")
    flaw = F.when(F.col("id") % 7 == 0, F.lit("<id>x")).otherwise(F.lit("<id>"))
    pages = dump.page_xml(i.dump_page, flaw)
    pages.write.text(path)
    return art.load_counts(dump.scan_dump(i.spark, path, bad="keep"))


@query("scan_tables", "select id, title, md5(body) as body from document")
def _(i: Inputs):
    path = fresh_path(i.spark, "document")
    i.documents.select("id", "title", "body").write.parquet(path)
    return scan_table(i.spark, path).select("id", "title", F.md5("body").alias("body"))


@query("write_documents", "select id, type, value from feature")
def _(i: Inputs):
    path = fresh_path(i.spark, "documents")
    sinks.write_documents(i.documents, path)
    return scan_table(i.spark, f"{path}/feature").select("id", "type", "value")


@query("write_articles", SQL_ARTICLE)
def _(i: Inputs):
    path = fresh_path(i.spark, "article")
    articles = art.article_rows(i.dump_page)
    sinks.write_articles(articles, path)
    sinks.write_articles(articles, path, reset=True)
    return dated(scan_table(i.spark, path))


@query(
    "append_rows",
    "select aid, title from search_article union all select id, title from dump_page where ns <> 0",
)
def _(i: Inputs):
    path = fresh_path(i.spark, "appended")
    i.search_article.select("aid", "title").write.parquet(path)
    sinks.append_rows(i.dump_page.filter("ns != 0").select(F.col("id").alias("aid"), "title"), path)
    return scan_table(i.spark, path)


@query("delete_by_id", "select id, title from document where id not in (select id from dump_page where title like 'A%')")
def _(i: Inputs):
    path = fresh_path(i.spark, "kept")
    gone = i.dump_page.filter(F.startswith("title", F.lit("A"))).select("id")
    sinks.rewrite_without(i.documents.select("id", "title"), gone, path)
    return scan_table(i.spark, path)


# Filters and rows


@query("f_ns0", sql_brief("ns = 0"))
def _(i: Inputs):
    return brief(art.in_main_namespace(i.dump_page))


@query("f_title_prefix", sql_brief(ARTICLE_TITLE))
def _(i: Inputs):
    return brief(art.with_article_title(i.dump_page))


@query("f_not_redirect_text", sql_brief(NO_REDIRECT_TEXT))
def _(i: Inputs):
    return brief(art.without_redirect_text(i.dump_page))


@query("f_not_redirect_elem", sql_brief("redirect is null"))
def _(i: Inputs):
    return brief(art.without_redirect_element(i.dump_page))


@query("f_body_present", sql_brief("text is not null"))
def _(i: Inputs):
    return brief(art.with_body(i.dump_page))


@query("fill_default", "select id, coalesce(redirect, '') as redirect, md5(coalesce(text, '')) as text from dump_page")
def _(i: Inputs):
    return art.fill_default(i.dump_page, "redirect", "text").select("id", "redirect", F.md5("text").alias("text"))


@query(
    "classify_page",
    "select id, title, case when ns <> 0 then 2 when redirect is not null then 1 else 0 end as type from dump_page",
)
def _(i: Inputs):
    return art.classify_page(i.dump_page).select("id", "title", "type")


@query("page_rows", f"select id, rev, strftime(date, '{STAMP}') as date, type, length, title from page")
def _(i: Inputs):
    return dated(art.page_rows(i.dump_page))


@query("redirect_rows", "select src, dst from redirect")
def _(i: Inputs):
    return art.redirect_rows(i.dump_page)


@query("article_rows", SQL_ARTICLE)
def _(i: Inputs):
    return dated(art.article_rows(i.dump_page))


@query("fetch_docs", "select id, title, md5(body) as body from (select id from dump_page) left join document using (id)")
def _(i: Inputs):
    found = art.fetch(i.dump_page.select("id"), i.documents, "title", "body")
    return found.select("id", "title", F.md5("body").alias("body"))


@query("fetch_titles", "select id, title from (select id from dump_page) left join document using (id)")
def _(i: Inputs):
    return art.fetch(i.dump_page.select("id"), i.documents, "title")


@query(
    "link_by_title",
    "select t.title, min(d.id) as id from (select distinct title from dump_page) t left join document d using (title) group by t.title",
)
def _(i: Inputs):
    return art.link_by_title(i.dump_page.select("title"), i.documents)


@query("union_tags", "select id, type, count(*) as n from feature group by all")
def _(i: Inputs):
    tags = art.document_tags(i.documents)
    both = art.union_tags(
        tags.select("id", F.explode("title_tags").alias("value")), tags.select("id", F.explode("body_tags").alias("value"))
    )
    return both.groupBy("id", "type").agg(F.count("*").alias("n"))


@query(
    "kind_counts",
    """select coalesce(type, -1) as type, count(*) as pages
       from (select case when ns <> 0 then 2 when redirect is not null then 1 else 0 end as type from dump_page)
       group by rollup (type)""",
)
def _(i: Inputs):
    return art.kind_counts(i.dump_page)


@query("limit_articles", "select aid, title from search_article order by aid limit 1000")
def _(i: Inputs):
    # A dump with its pages in the order of their ids: files by name, pages in each.
    path = fresh_path(i.spark, "ordered-dump")
    dump.page_xml(i.dump_page.orderBy("id")).write.text(path)
    pages = dump.scan_dump(i.spark, path, namespace=0, place=True)
    return first_rows(art.article_rows(pages).select("aid", "title", "place"), 1000)


@query("limit_by_id", "select aid, title from search_article order by aid limit 100")
def _(i: Inputs):
    return art.limit_rows(i.search_article.select("aid", "title"), 100)


# Scalar functions


@query("unescape", f"select page_id, {decoded('html')} as out from pages")
def _(i: Inputs):
    return i.given("pages").select("page_id", unescape(F.col("html")).alias("out"))


@query("title_tokens", f"select id, unnest({feature_tokens('title')}) as token from dump_page")
def _(i: Inputs):
    return i.dump_page.select("id", F.explode(tx.title_tokens(F.col("title"))).alias("token"))


@query(
    "body_tokens",
    f"select id, token, count(*) as n from (select id, unnest({body_tokens('text')}) as token from dump_page) group by all",
)
def _(i: Inputs):
    tokens = i.dump_page.select("id", F.explode(tx.body_tokens(F.col("text"))).alias("token"))
    return tokens.groupBy("id", "token").agg(F.count("*").alias("n"))


@query("reduce_text", TEXT.format(reduced("text")))
def _(i: Inputs):
    return i.given("documents").select("doc_id", tx.reduce_text(F.col("text")).alias("out"))


@query(
    "count_tokens",
    r"""select doc_id, token, count(*) as n
        from (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) as token from documents)
        group by all""",
)
def _(i: Inputs):
    tokens = i.given("documents").select("doc_id", F.explode(tx.count_tokens(F.col("text"))).alias("token"))
    return tokens.groupBy("doc_id", "token").agg(F.count("*").alias("n"))


# Texts with blank lines and blanks at line ends, so that there is something to normalise.
LOOSE = [(r"\. ", " .  \n \n\n  "), (r", ", " ,\t\n ")]


def _loose_sql(x: str) -> str:
    for pattern, change in LOOSE:
        x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(change)}, 'g')"
    return x


_lines = (
    f"array_to_string(list_transform(string_split({_loose_sql('text')}, chr(10)), "
    f"lambda s: regexp_replace(s, '^{SPACE}+|{SPACE}+$', '', 'g')), chr(10))"
)


@query(
    "normalize_text",
    TEXT.format(
        f"regexp_replace(regexp_replace({_lines}, '\\n{{2,}}', chr(10) || chr(10), 'g'), "
        f"'\\A{SPACE}+|{SPACE}+\\z', '', 'g')"
    ),
)
def _(i: Inputs):
    loose = F.col("text")
    for pattern, change in LOOSE:
        loose = F.regexp_replace(loose, pattern, change)
    return i.given("documents").select("doc_id", tx.normalize_text(loose).alias("out"))


@query(
    "normalize_html",
    f"""select page_id, regexp_replace(regexp_replace(replace(html, '<p>', '<br/><br/><br/> '), '(<br/>){{2,}}', '<br/>', 'g'),
               '\\A{SPACE}+|{SPACE}+\\z', '', 'g') as out from pages""",
)
def _(i: Inputs):
    html = F.replace(F.col("html"), F.lit("<p>"), F.lit("<br/><br/><br/> "))
    return i.given("pages").select("page_id", tx.normalize_html(html).alias("out"))


@query("escape_link", "select id, replace(title, ' ', '_') as href, replace(replace(title, ' ', '_'), '_', ' ') as back from dump_page")
def _(i: Inputs):
    href = tx.escape_link(F.col("title"))
    return i.dump_page.select("id", href.alias("href"), tx.unescape_link(href).alias("back"))


@query("unescape_link", "select id, replace(title, '_', ' ') as out from dump_page")
def _(i: Inputs):
    return i.dump_page.select("id", tx.unescape_link(F.col("title")).alias("out"))


@query("capitalize", f"select word, {cap('word')} as out from words")
def _(i: Inputs):
    return i.words.select("word", tx.capitalize(F.col("word")).alias("out"))
