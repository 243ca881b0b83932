"""Substring and ranked search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import escape_link
from ..operators import search as se
from ..operators.block_index import BlockIndex, compact
from ..session import fresh_path
from .catalog import query
from .check_sql import LIKE_SQL, PARTS
from .derived import Inputs


def hits_sql(which: str, first: int, last: int) -> str:
    return f"select qid, rank, aid, title, score from h_{which} where rank between {first} and {last}"


# Questions that are article titles, for the searches that look one title up.
TITLE_PARTS = {"questions": "select title as qid, title as query from search_article"}


def title_questions(i: Inputs):
    return i.search_article.select(F.col("title").alias("qid"), F.col("title").alias("query"))


@query("search_like", LIKE_SQL)
def _(i: Inputs):
    return se.search_like(i.features, i.like_queries, i.like_index)


@query("search_all", "select id from document")
def _(i: Inputs):
    return se.search_all(i.documents)


@query("distinct_ids", "select distinct id from feature where value like '%tion%'")
def _(i: Inputs):
    return se.distinct_ids(i.features.filter(F.contains("value", F.lit("tion"))))


@query("take_hits", "select distinct id from feature where value like '%tion%' order by id limit 100")
def _(i: Inputs):
    return se.take_hits(se.distinct_ids(i.features.filter(F.contains("value", F.lit("tion")))), 100)


@query(
    "intersect_terms",
    "select id from feature where value like '%tion%' intersect select id from feature where value like '%ment%'",
)
def _(i: Inputs):
    hits = [i.features.filter(F.contains("value", F.lit(t))) for t in ("tion", "ment")]
    return se.intersect_terms(*hits)


@query("postings", "select id, term, len, tf from p_text")
def _(i: Inputs):
    return se.postings(i.search_article, "text")


@query("search_title", hits_sql("title", 1, 10))
def _(i: Inputs):
    return se.search_title(i.search_article, i.questions, index=i.title_index)


@query("search_unindexed", hits_sql("text", 1, 10))
def _(i: Inputs):
    return se.search_field(i.search_article, i.questions, "text")


@query("search_field", hits_sql("text", 1, 10))
def _(i: Inputs):
    return se.search_field(i.search_article, i.questions, "text", index=i.text_index)


# The articles of an index that later ones were added to and some were taken out of.
UPDATED = {
    "every_article": PARTS["search_article"],
    "search_article": "select * from every_article where not starts_with(title, 'D')",
}


def updated_index(i: Inputs, compacted: bool) -> BlockIndex:
    path, late = fresh_path(i.spark, "updated-index"), F.col("date") >= F.lit("2010-01-01").cast("timestamp")
    se.write_index(se.field_index(i.search_article.filter(~late), "title"), path)
    se.insert_into_index(se.field_index(i.search_article.filter(late), "title"), path)
    se.delete_from_index(i.search_article.filter(F.startswith("title", F.lit("D"))).select("aid"), path)
    if compacted:
        compact(i.spark, path)
    return se.read_index(i.spark, path)


@query("search_updated", hits_sql("title", 1, 10), **UPDATED)
def _(i: Inputs):
    return se.search_title(i.search_article, i.questions, index=updated_index(i, compacted=False))


@query("search_compacted", hits_sql("title", 1, 10), **UPDATED)
def _(i: Inputs):
    return se.search_title(i.search_article, i.questions, index=updated_index(i, compacted=True))


@query("search_effort")
def _(i: Inputs):
    return se.search_effort(i.questions, i.text_index)


@query("search_by_id", "select cast(aid as varchar) as qid, 1 as rank, aid, title, 1.0 as score from search_article")
def _(i: Inputs):
    ids = i.search_article.select(F.col("aid").cast("string").alias("qid"), F.col("aid").cast("string").alias("query"))
    return se.search_field(i.search_article, ids, "aid")


@query("search_dismax", hits_sql("best", 1, 10))
def _(i: Inputs):
    return se.search_dismax(i.search_article, i.questions, indexes=i.indexes)


@query("search_page", hits_sql("best", 1, 25))
def _(i: Inputs):
    return se.search_dismax(i.search_article, i.questions, indexes=i.indexes, size=25)


@query("next_page", hits_sql("best", 26, 35))
def _(i: Inputs):
    base, size = se.next_page(0, 25)
    return se.search_dismax(i.search_article, i.questions, indexes=i.indexes, size=size, base=base)


@query(
    "page_done",
    "select qid, count(*) < 25 as done from h_title where rank <= 25 group by qid",
)
def _(i: Inputs):
    return se.page_done(se.search_title(i.search_article, i.questions, size=25, index=i.title_index), 25)


@query("first_hit", hits_sql("title", 1, 1), **TITLE_PARTS)
def _(i: Inputs):
    return se.first_hit(se.search_title(i.search_article, title_questions(i), size=1, index=i.title_index))


@query("result_rows", "select aid, title from h_title where rank <= 10")
def _(i: Inputs):
    return se.result_rows(se.search_title(i.search_article, i.questions, index=i.title_index))


@query(
    "link_by_term",
    "select t.word as term, h.aid from words t left join h_title h on h.qid = t.word and h.rank = 1",
    questions="select word as qid, word as query from words",
)
def _(i: Inputs):
    return se.link_by_term(i.search_article, i.words.select(F.col("word").alias("term")), i.title_index)


@query(
    "resolve_href",
    "select qid as href, aid, title from h_title where rank = 1",
    questions="select distinct replace(title, ' ', '_') as qid, replace(replace(title, ' ', '_'), '_', ' ') as query from search_article",
)
def _(i: Inputs):
    return se.resolve_href(i.search_article, i.search_article.select(escape_link(F.col("title")).alias("href")), i.title_index)
