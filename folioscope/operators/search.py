"""Substring search over features and ranked search over articles, for whole tables of queries."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import match_tokens, unescape_link
from ..session import stage
from . import block_index as blocks
from . import substrings
from .block_index import SCORE_DECIMALS, BlockIndex, inverse_df, part_score
from .joins import BROADCAST_ROWS, broadcast_if_small, is_small, salted_join, top_per_group
from .substrings import SubstringIndex, search_substrings, substring_index

# Fixed value: hits of a page.
PAGE = 10


# Substring search


def search_like(features: DataFrame, queries: DataFrame | list[tuple[int, str]], index: SubstringIndex | None = None) -> DataFrame:
    """``(qid, id)`` of the documents whose features match all terms of a query.

    ``queries`` is a table ``qid, query``, or a short list. A term must be part of a title token and of
    a body token, ``@term`` only of a title token; ``%`` and ``_`` are wildcards and case does not
    matter. ``index`` is the stored index of the features, if there is one. Queries of blanks give no
    rows; for the empty query use `search_all`.
    """
    if isinstance(queries, list):
        queries = features.sparkSession.createDataFrame(queries, "qid INT, query STRING")
    return search_substrings(index or substring_index(features), queries)


def search_all(docs: DataFrame) -> DataFrame:
    """The empty query: all ids."""
    return docs.select("id")


def intersect_terms(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("id").intersect(right.select("id"))


def distinct_ids(hits: DataFrame) -> DataFrame:
    return hits.select("id").distinct()


def take_hits(hits: DataFrame, n: int) -> DataFrame:
    """The first ``n`` ids of an unranked result, smallest first."""
    return hits.select("id").orderBy("id").limit(n)


# Ranked search


class FieldIndex(NamedTuple):
    """What ranked search needs to know of a text field, computed when it is used."""

    postings: DataFrame  # id, term, len, tf; len is the number of terms in the document
    size: DataFrame  # one row: docs, avg; documents without terms do not count
    texts: DataFrame  # id, text


def field_index(articles: DataFrame, field: str, key: str = "aid") -> FieldIndex:
    """Index of a field; `write_index` stores it."""
    texts = articles.select(F.col(key).alias("id"), F.col(field).alias("text"))
    # Texts move to the task of their id, as texts: their terms are counted there and move no more.
    words = texts.repartition("id").select("id", match_tokens(F.col("text")).alias("terms"))
    spread = words.select("id", F.size("terms").alias("len"), F.explode("terms").alias("term"))
    lengths = texts.select(F.size(match_tokens(F.col("text"))).alias("len"))
    docs = F.count_if(F.col("len") > 0)
    return FieldIndex(
        spread.groupBy("id", "term", "len").agg(F.count("*").alias("tf")),
        lengths.agg(docs.alias("docs"), (F.sum("len") / F.nullif(docs, F.lit(0))).alias("avg")),
        texts,
    )


def postings(articles: DataFrame, field: str, key: str = "aid") -> DataFrame:
    return field_index(articles, field, key).postings


def write_index(index: FieldIndex, path: str) -> None:
    """Store an index in blocks, ordered by term, so a search for few terms skips most of them."""
    blocks.create(index.texts, path)


def read_index(spark: SparkSession, path: str) -> BlockIndex:
    return blocks.read(spark, path)


def insert_into_index(index: FieldIndex, path: str) -> None:
    """Add further documents to a stored index; what is stored stays as it is."""
    blocks.insert(index.texts, path)


def delete_from_index(ids: DataFrame, path: str, key: str = "aid") -> None:
    """Take documents out of a stored index; what is stored stays as it is."""
    blocks.delete(ids.select(F.col(key).alias("id")), path)


def _query_terms(queries: DataFrame) -> DataFrame:
    terms = queries.select("qid", F.explode(match_tokens(F.col("query"))).alias("term"))
    return terms.groupBy("qid", "term").agg(F.count("*").alias("times"))


def score(index: FieldIndex, queries: DataFrame) -> DataFrame:
    """``(qid, id, score)`` of every document that shares a term with a query, without a stored index.

    ``queries`` is ``(qid, query)``. Postings of terms no query asks for are dropped in the tasks that
    read the text, before any shuffle. The score is that of `block_index.best_hits`.
    """
    asked = _query_terms(queries)
    few = is_small(asked)
    terms = asked.select("term").distinct()
    found = stage(index.postings.join(F.broadcast(terms) if few else terms, "term", "left_semi"), "found")
    spelled = found.groupBy("term").agg(F.count("*").alias("df"))
    size = index.size.select(F.struct("docs", "avg")).scalar()
    weighted = asked.join(spelled, "term").select("qid", "term", (inverse_df(size["docs"], F.col("df")) * F.col("times")).alias("weight"))
    if few:
        # ``weighted`` has no more rows than ``asked``. With all postings of a document in one task
        # the scores need no further shuffle, and only the best of each task go on.
        matched = found.repartition("id").join(F.broadcast(weighted), "term")
    else:
        matched = salted_join(found, weighted, "term", counts=spelled.withColumnRenamed("df", "rows"))
    part = F.col("weight") * part_score(F.col("tf"), F.col("len"), size["avg"])
    return matched.groupBy("qid", "id").agg(F.round(F.sum(part), SCORE_DECIMALS).alias("score"))


def _hits(articles: DataFrame, queries: DataFrame, field: str, last: int, key: str, index: BlockIndex | None) -> DataFrame:
    """``qid, id, score`` of at least the best ``last`` hits of each query."""
    if index is not None:
        return blocks.best_hits(index, _query_terms(queries), last)
    return score(field_index(articles, field, key), queries)


def search_effort(queries: DataFrame, index: BlockIndex, size: int = PAGE) -> DataFrame:
    """Per query, the postings of its terms and how many of them a search of a stored index scores."""
    return blocks.effort(index, _query_terms(queries), size)


def _page(
    scored: DataFrame, articles: DataFrame, queries: DataFrame, size: int, base: int, key: str
) -> DataFrame:
    best = top_per_group(scored, ["qid"], [F.desc("score"), F.col("id")], size, base)
    titles = articles.select(F.col(key).alias("id"), "title")
    # Each query has at most ``size`` hits, so counting queries bounds them without a search.
    few = is_small(queries.select("qid"), max_rows=BROADCAST_ROWS // max(size, 1))
    return titles.join(F.broadcast(best) if few else best, "id").select("qid", "rank", F.col("id").alias(key), "title", "score")


def search_field(
    articles: DataFrame,
    queries: DataFrame,
    field: str,
    size: int = PAGE,
    base: int = 0,
    key: str = "aid",
    index: BlockIndex | None = None,
) -> DataFrame:
    """Ranked hits on a field: any term counts, best first, ties by id.

    ``index`` is the stored index of the field, if there is one. On the id field the query is a number and only equality counts.
    """
    if field == key:
        asked = queries.select("qid", F.expr("try_cast(query AS BIGINT)").alias(key))
        hits = articles.select(key, "title").join(broadcast_if_small(asked), key)
        # ids are unique, so a query has one hit: that of rank 1, on the first page
        return hits.where(F.lit(base < 1 <= base + size)).select("qid", F.lit(1).alias("rank"), key, "title", F.lit(1.0).alias("score"))
    return _page(_hits(articles, queries, field, base + size, key, index), articles, queries, size, base, key)


def search_title(
    articles: DataFrame, queries: DataFrame, size: int = PAGE, base: int = 0, index: BlockIndex | None = None
) -> DataFrame:
    return search_field(articles, queries, "title", size, base, index=index)


def search_dismax(
    articles: DataFrame,
    queries: DataFrame,
    fields: tuple[str, ...] = ("title", "text"),
    size: int = PAGE,
    base: int = 0,
    key: str = "aid",
    indexes: dict[str, BlockIndex] | None = None,
) -> DataFrame:
    """Ranked hits where a document counts by its best field.

    A document among the best is so in its best field too, so the best of each field are enough.
    """
    scored = None
    for field in fields:
        part = _hits(articles, queries, field, base + size, key, (indexes or {}).get(field))
        scored = part if scored is None else scored.unionByName(part)
    best = scored.groupBy("qid", "id").agg(F.max("score").alias("score"))
    return _page(best, articles, queries, size, base, key)


def next_page(base: int, size: int, n: int = PAGE) -> tuple[int, int]:
    """Bounds of the page after ``(base, size)``, of ``n`` rows."""
    return base + size, n


def page_done(hits: DataFrame, size: int) -> DataFrame:
    """Whether each query has no further page: it returned fewer rows than asked for."""
    return hits.groupBy("qid").agg((F.count("*") < size).alias("done"))


def first_hit(hits: DataFrame) -> DataFrame:
    """Best hit per query; queries without a hit have no row."""
    return hits.filter("rank = 1")


def result_rows(hits: DataFrame, key: str = "aid") -> DataFrame:
    return hits.select(key, "title")


def link_by_term(articles: DataFrame, terms: DataFrame, index: BlockIndex | None = None) -> DataFrame:
    """Best article whose title holds the given token; null where no title does.

    The token is matched as given, not analysed, so one in upper case finds nothing.
    """
    asked = terms.select("term").distinct()
    known = asked.filter(match_tokens(F.col("term")) == F.array("term"))
    queries = known.select(F.col("term").alias("qid"), F.col("term").alias("query"))
    hits = first_hit(search_title(articles, queries, size=1, index=index))
    return asked.join(hits.select(F.col("qid").alias("term"), "aid"), "term", "left")


def resolve_href(articles: DataFrame, hrefs: DataFrame, index: BlockIndex | None = None) -> DataFrame:
    """Article a link address leads to: underscores as blanks, best title match."""
    asked = hrefs.select(F.col("href").alias("qid"), unescape_link(F.col("href")).alias("query")).distinct()
    return first_hit(search_title(articles, asked, size=1, index=index)).select(F.col("qid").alias("href"), "aid", "title")
