"""Inputs of the registered queries, derived by Spark from the given tables.

The given tables hold no wikitext, so documents become articles: a document takes the most
frequent word first seen in it as its title, and words of its text become links, templates, notes
and headings. The other words first seen in a document are redirect pages that lead to each other
and to the title. Web pages become pages of other kinds. What is costly to derive is staged once per
session, as the jobs would have stored it. `check_sql` states the same in SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import articles as art
from ..operators import graph as gr
from ..operators import history as hist
from ..operators import ngrams as ng
from ..operators import search as se
from ..operators import substrings as sub
from ..operators.block_index import BlockIndex
from ..operators.joins import is_small
from ..session import fresh_path, in_parts, spread, stage
from ..sources.dump import page_xml

# Ids: a document's article has doc_id * ID_STEP, its redirects follow, a web page ends the block.
# No document has as many words as a block has ids.
ID_STEP = 1_000_000
SERIES_TOKENS = ["the", "le", "die", "que", "notaword"]
LIKE_QUERIES = [(1, "tion"), (2, "@ment"), (3, "the ou"), (4, "t_e %on"), (5, "@notaword"), (6, "E @ch"), (7, "%"), (8, "@_____________")]

WIKI_STEPS = [
    (r"([\p{L}\p{N}_]{2,})( [\p{L}\p{N}_]{2,})", r"[[\1]]\2"),
    (r"(\p{L}{3,}), ", r"[[\1#Part|the \1]], "),
    (r"(\p{L}{3,})\.\n", "\\1.<ref>{{cite web|title=\\1}}</ref>\n\n== Part \\1 ==\n[[Category:Sample]]\n"),
    (r"(\p{L}{3,})\. ", r"\1 {{note|{{lang|\1}}}}{{cite book|\1}} [http://example.org/\1 see \1]. "),
]


def derived_wiki(text: Column) -> Column:
    for pattern, change in WIKI_STEPS:
        # What follows a run of letters is none, so runs are taken whole and from their start, without trying their parts.
        pattern = pattern.replace("{2,})", "{2,}+)").replace(r"(\p{L}{3,})", r"(?<!\p{L})(\p{L}{3,}+)")
        text = F.regexp_replace(text, pattern, change.replace("\\1", "$1").replace("\\2", "$2"))
    return text


class Inputs:
    """Lazily staged tables over one folder of given tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _stage(self, df: DataFrame, name: str) -> DataFrame:
        return stage(df, name, compression="zstd")

    @cached_property
    def words(self) -> DataFrame:
        """``word, n, owner``: uses, and the first document with the word."""
        used = spread(self.given("documents")).select("doc_id", F.explode(tx.count_tokens(F.col("text"))).alias("word"))
        words = used.groupBy("word").agg(F.count("*").alias("n"), F.min("doc_id").alias("owner"))
        return self._stage(words, "words")

    @cached_property
    def owned(self) -> DataFrame:
        # The words first seen in one document: never more than that document has.
        by_use = W.partitionBy("owner").orderBy(F.desc("n"), "word")
        r = F.row_number().over(by_use) - 1
        before, after = F.lag("word").over(by_use), F.lead("word").over(by_use)
        head = F.first("word").over(by_use)
        target = (
            F.when((r % 10 == 8) & after.isNotNull(), after).when(r % 10 == 9, before)
            .when(r % 50 == 25, F.col("word")).when(r % 4 == 0, head).otherwise(before)
        )
        return self._stage(self.words.select("owner", "word", r.alias("r"), target.alias("target")), "owned")

    @cached_property
    def article(self) -> DataFrame:
        """Articles as dump pages."""
        docs = spread(self.given("documents"))
        heads = self.owned.filter("r = 0").select(F.col("owner").alias("doc_id"), "word")
        # A hash table of the titles: texts are not sorted for the join.
        heads = F.broadcast(heads) if is_small(heads) else heads.hint("shuffle_hash")
        title = F.coalesce(tx.capitalize(F.col("word")), F.concat(F.lit("Document "), F.col("doc_id").cast("string")))
        rows = docs.join(heads, "doc_id", "left").select(
            (F.col("doc_id") * ID_STEP).alias("id"),
            F.lit(0).alias("ns"),
            title.alias("title"),
            F.lit(None).cast("string").alias("redirect"),
            (F.col("doc_id") + 500_000).alias("rid"),
            _date(F.col("doc_id")).alias("date"),
            derived_wiki(F.col("text")).alias("text"),
        )
        return self._stage(rows, "article")

    @cached_property
    def dump_page(self) -> DataFrame:
        """Every page of the derived dump, read from where its parts are: no text is stored again."""
        r = F.col("r")
        target = tx.capitalize(F.col("target"))
        spelling = F.when(r % 3 == 0, "#REDIRECT ").when(r % 3 == 1, "#redirect ").otherwise("#Redirect ")
        redirects = self.owned.filter("r > 0").select(
            (F.col("owner") * ID_STEP + r).alias("id"),
            F.lit(0).alias("ns"),
            tx.capitalize(F.col("word")).alias("title"),
            target.alias("redirect"),
            (F.col("owner") * ID_STEP + r + 1).alias("rid"),
            _date(F.col("owner")).alias("date"),
            F.concat(spelling, F.lit("[["), target, F.lit("]]")).alias("text"),
        )
        page = F.col("page_id")
        kinds = [(1, "Talk:"), (2, "User:"), (4, "Wikipedia:"), (14, "Category:"), (10, "Template:"), (0, "Wikipedia ")]
        ns, start = F.lit(None), F.lit(None)
        for n, (space, prefix) in enumerate(kinds):
            ns = F.when(page % 6 == n, space).otherwise(ns)
            start = F.when(page % 6 == n, prefix).otherwise(start)
        others = self.given("pages").select(
            (page * ID_STEP + ID_STEP - 1).alias("id"),
            ns.cast("int").alias("ns"),
            F.concat(start, F.col("url")).alias("title"),
            F.lit(None).cast("string").alias("redirect"),
            (page + 900_000).alias("rid"),
            _date(page).alias("date"),
            F.when(page % 12 != 11, F.col("html")).alias("text"),
        )
        return self.article.unionByName(redirects).unionByName(others)

    @cached_property
    def dump_file(self) -> str:
        """The derived dump as XML text."""
        path = fresh_path(self.spark, "dump-xml")
        page_xml(self.dump_page).write.text(path)
        return path

    @cached_property
    def documents(self) -> DataFrame:
        return self._stage(art.document_rows(self.dump_page), "documents")

    @cached_property
    def features(self) -> DataFrame:
        return self._stage(art.feature_rows(self.documents), "features")

    @cached_property
    def search_article(self) -> DataFrame:
        return art.article_rows(self.dump_page)

    def _index(self, field: str) -> BlockIndex:
        path = fresh_path(self.spark, f"{field}-index")
        se.write_index(se.field_index(self.search_article, field), path)
        return se.read_index(self.spark, path)

    @cached_property
    def title_index(self) -> BlockIndex:
        return self._index("title")

    @cached_property
    def text_index(self) -> BlockIndex:
        return self._index("text")

    @cached_property
    def like_index(self) -> sub.SubstringIndex:
        path = fresh_path(self.spark, "like-index")
        sub.write_substring_index(sub.substring_index(self.features), path)
        return sub.read_substring_index(self.spark, path)

    @cached_property
    def like_queries(self) -> DataFrame:
        """``qid, query``: parts of two words of each question, and some odd queries."""
        words = F.filter(tx.count_tokens(F.col("query")), lambda w: F.length(w) > 5)
        part = [F.substr(words[k], F.lit(k + 1), F.lit(4)) for k in (0, 1)]
        asked = F.concat(F.lit("@"), F.substr(words[0], F.lit(1), F.lit(3)), F.lit(" "), part[0], F.lit(" @"), part[1])
        questions = self.questions.filter(F.size(words) > 1).select((F.col("qid") + 100).alias("qid"), asked.alias("query"))
        return questions.unionByName(self.spark.createDataFrame(LIKE_QUERIES, "qid BIGINT, query STRING"))

    @property
    def indexes(self) -> dict[str, BlockIndex]:
        return {"title": self.title_index, "text": self.text_index}

    @cached_property
    def questions(self) -> DataFrame:
        """``qid, query``: the passages of the benchmark table."""
        return self.given("benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))

    @cached_property
    def page(self) -> DataFrame:
        return self._stage(art.page_rows(self.dump_page), "page")

    @cached_property
    def title_link(self) -> DataFrame:
        """With the column of parts, as is `id_link`."""
        return in_parts(gr.extract_links(self.dump_page, decode=False), "title-link")

    @cached_property
    def redirect(self) -> DataFrame:
        return self._stage(art.redirect_rows(self.dump_page), "redirect")

    @cached_property
    def id_link(self) -> DataFrame:
        return gr.join_link_ids(self.title_link, self.page)

    @cached_property
    def id_redirect(self) -> DataFrame:
        return self._stage(gr.join_redirect_ids(self.redirect, self.page), "id-redirect")

    @cached_property
    def final_redirect(self) -> DataFrame:
        return self._stage(gr.redirect_closure(self.id_redirect), "final-redirect")

    @cached_property
    def final_link(self) -> DataFrame:
        return gr.join_final_links(self.id_link, self.final_redirect)

    @cached_property
    def ranks(self) -> DataFrame:
        return gr.page_rank(self.final_link, rounds=10)

    @cached_property
    def diffs(self) -> DataFrame:
        """``time, words``: every document as an edit at its date."""
        date = F.date_format(_date(F.col("doc_id")), "yyyy-MM-dd HH:mm:ss")
        return spread(self.given("documents")).select(date.alias("time"), F.col("text").alias("words"))

    @cached_property
    def vocab(self) -> DataFrame:
        """``token, idx``: every token of the documents, numbered in token order."""
        return self._stage(ng.vocabulary(self.words.select(F.col("word").alias("token"))), "vocab")

    @cached_property
    def counts(self) -> DataFrame:
        return self._stage(ng.month_token_count(self.diffs, self.vocab), "counts")

    @cached_property
    def requests(self) -> DataFrame:
        """Requests for each token of the questions, with a capital, and for an unknown token."""
        tokens = self.questions.select(F.explode(tx.count_tokens(F.col("query"))).alias("token")).distinct()
        return tokens.select(F.concat(tx.capitalize(F.col("token")), F.lit(","), F.col("token"), F.lit("_x")).alias("tokens"))

    @cached_property
    def messages(self) -> DataFrame:
        """Visit messages: events as page addresses of several shapes, some from a foreign host."""
        event, user = F.col("event_id"), F.col("user_id").cast("string")
        lang = F.when(F.col("user_id") % 2 == 0, "en").otherwise("de")
        host = F.when(F.col("event_type") == "error", "https://www.example.org/wiki/").otherwise(
            F.concat(F.lit("https://"), lang, F.lit(".wikipedia.org/wiki/"))
        )
        path = (
            F.when(event % 4 == 0, F.concat(F.lit("Page_"), user))
            .when(event % 4 == 1, F.concat(F.lit("C%2B%2B+"), user))
            .when(event % 4 == 2, F.concat(F.lit("Page_"), user, F.lit("#Top")))
            .otherwise(F.concat(F.lit("#"), user, F.lit("#x")))
        )
        ms = F.unix_millis(F.col("ts").cast("timestamp")).cast("double")
        return self._stage(
            self.given("events").select(F.concat(host, path).alias("url"), ms.alias("timestamp")), "messages"
        )

    @cached_property
    def message_files(self) -> str:
        path = fresh_path(self.spark, "message-json")
        self.messages.repartition(4).write.json(path)
        return path

    @cached_property
    def views(self) -> DataFrame:
        return self._stage(hist.view_rows(self.messages), "views")


def _date(number: Column) -> Column:
    days = F.make_dt_interval((number * 7 % 6000).cast("int"))
    return (F.lit("2001-01-01 00:00:00").cast("timestamp_ntz") + days).cast("timestamp")


_inputs: dict[tuple[str, str], Inputs] = {}


def inputs(spark: SparkSession, folder: str) -> Inputs:
    """The inputs over ``folder``, shared by all queries of the session."""
    key = (spark.sparkContext.applicationId, folder.rstrip("/"))
    if key not in _inputs:
        _inputs[key] = Inputs(spark, key[1])
    return _inputs[key]
