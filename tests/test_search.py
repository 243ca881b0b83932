import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioscope.operators import search as se

WORDS = ["the", "Cat", "dog", "Éclair", "bird", "x1", "of", "an-t"]


def make(spark, count=60, seed=11):
    rng = random.Random(seed)
    data = [
        (n, " ".join(rng.choices(WORDS, k=rng.randint(0, 3))), " ".join(rng.choices(WORDS, k=rng.randint(0, 30))))
        for n in range(count)
    ]
    return data, spark.createDataFrame(data, "aid BIGINT, title STRING, text STRING")


def terms(text):
    return re.findall(r"\w+", text.lower())


def ranked(data, column, queries):
    docs = {r[0]: terms(r[column]) for r in data}
    held = [d for d in docs.values() if d]
    mean = sum(map(len, held)) / len(held)
    scores = {}
    for qid, query in queries:
        for term, times in Counter(terms(query)).items():
            df = sum(term in d for d in held)
            for aid, d in docs.items():
                tf = d.count(term)
                if tf:
                    idf = math.log(1 + (len(held) - df + 0.5) / (df + 0.5))
                    part = times * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
                    scores[qid, aid] = scores.get((qid, aid), 0.0) + part
    return {k: round(v, 6) for k, v in scores.items()}


QUERIES = [(1, "cat the"), (2, "éclair ECLAIR bird bird"), (3, "nothing here"), (4, ""), (5, "an t of x1")]


def top(scores, size, base=0):
    out = []
    for qid in {q for q, _ in scores}:
        hits = sorted(((-s, aid) for (q, aid), s in scores.items() if q == qid))
        out += [(qid, n + 1, aid, -s) for n, (s, aid) in enumerate(hits)][base : base + size]
    return sorted(out)


def hits(df):
    return sorted((r["qid"], r["rank"], r["aid"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("few", [True, False])
def test_ranked_search_equals_formula(spark, monkeypatch, few):
    monkeypatch.setattr(se, "is_small", lambda df, **bounds: few)
    monkeypatch.setattr(se.blocks, "is_small", lambda df, **bounds: few)
    data, articles = make(spark)
    queries = spark.createDataFrame(QUERIES, "qid INT, query STRING")
    assert hits(se.search_field(articles, queries, "text", size=7)) == top(ranked(data, 2, QUERIES), 7)
    assert hits(se.search_title(articles, queries)) == top(ranked(data, 1, QUERIES), 10)


def test_stored_index_and_pages(spark, tmp_path):
    data, articles = make(spark)
    queries = spark.createDataFrame(QUERIES, "qid INT, query STRING")
    path = str(tmp_path / "index")
    se.write_index(se.field_index(articles, "text"), path)
    index = se.read_index(spark, path)
    scores = ranked(data, 2, QUERIES)
    base, size = se.next_page(0, 25)
    assert (base, size) == (25, 10)
    assert hits(se.search_field(articles, queries, "text", size, base, index=index)) == top(scores, size, base)
    first = se.search_field(articles, queries, "text", 25, index=index)
    done = {r["qid"]: r["done"] for r in se.page_done(first, 25).collect()}
    assert done == {q: sum(1 for k in scores if k[0] == q) < 25 for q in {k[0] for k in scores}}
    assert {r["rank"] for r in se.first_hit(first).collect()} == {1}


def test_dismax_takes_the_better_field(spark):
    data, articles = make(spark)
    queries = spark.createDataFrame(QUERIES, "qid INT, query STRING")
    title, text = ranked(data, 1, QUERIES), ranked(data, 2, QUERIES)
    best = {k: max(title.get(k, 0), text.get(k, 0)) for k in title.keys() | text.keys()}
    assert hits(se.search_dismax(articles, queries)) == top(best, 10)
    assert hits(se.search_dismax(articles, queries, fields=("title",))) == top(title, 10)


def test_search_by_number(spark):
    _, articles = make(spark)
    queries = spark.createDataFrame([(1, "7"), (2, "x"), (3, "900")], "qid INT, query STRING")
    assert [(r["qid"], r["aid"]) for r in se.search_field(articles, queries, "aid").collect()] == [(1, 7)]


def test_links_by_token_and_address(spark):
    articles = spark.createDataFrame([(1, "Big cat", ""), (2, "Cat", ""), (3, "Dog_x", "")], "aid BIGINT, title STRING, text STRING")
    asked = spark.createDataFrame([("cat",), ("Cat",), ("big cat",), ("bird",)], "term STRING")
    found = {r["term"]: r["aid"] for r in se.link_by_term(articles, asked).collect()}
    assert found == {"cat": 2, "Cat": None, "big cat": None, "bird": None}
    hrefs = spark.createDataFrame([("Big_cat",), ("none",)], "href STRING")
    assert [tuple(r) for r in se.resolve_href(articles, hrefs).collect()] == [("Big_cat", 1, "Big cat")]


FEATURES = [
    (1, "title", "running"), (1, "body", "running"), (1, "body", "shoes"), (2, "title", "Shoes"), (2, "body", "shoes"),
    (2, "body", "running"), (3, "title", "a%b"), (3, "body", "a%b"), (3, "title", "it's"), (4, "title", "back\\slash"),
]


def test_search_like(spark):
    features = spark.createDataFrame(FEATURES, "id BIGINT, type STRING, value STRING")
    queries = [(1, "RUN"), (2, "shoe"), (3, "@run"), (4, "shoe run"), (5, "@sh_es"), (6, "  "), (7, "a\\%b"), (8, "@it's"),
               (9, "@k\\s"), (10, "@run @run"), (11, "r%g")]
    got = sorted(map(tuple, se.search_like(features, queries).collect()))
    assert got == [(1, 1), (2, 2), (3, 1), (5, 2), (8, 3), (9, 4), (10, 1), (11, 1)]


def test_unranked_results(spark):
    features = spark.createDataFrame(FEATURES, "id BIGINT, type STRING, value STRING")
    assert sorted(r["id"] for r in se.distinct_ids(features).collect()) == [1, 2, 3, 4]
    assert [r["id"] for r in se.take_hits(se.distinct_ids(features), 2).collect()] == [1, 2]
    titles, bodies = features.filter("type = 'title'"), features.filter(F.col("value").contains("shoes"))
    assert sorted(r["id"] for r in se.intersect_terms(titles, bodies).collect()) == [1, 2]


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(se.blocks, "BLOCK_BITS", 2)


def stored(spark, articles, path, field="text"):
    se.write_index(se.field_index(articles, field), path)
    return se.read_index(spark, path)


def skewed(spark, count, seed):
    """Rows with words from very common to rare."""
    rng = random.Random(seed)
    words = [f"w{int(40 * rng.random() ** 3)}" for _ in range(400)]
    data = [(n, "", " ".join(rng.choices(words, k=rng.randrange(0, 25)))) for n in range(count)]
    return data, spark.createDataFrame(data, "aid BIGINT, title STRING, text STRING")


@pytest.mark.parametrize("seed", [1, 2])
def test_early_stop_equals_full_scoring(spark, small_blocks, tmp_path, seed):
    data, articles = skewed(spark, 400, seed)
    rng = random.Random(seed + 50)
    asked = [(n, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(0, 5)))) for n in range(40)]
    queries = spark.createDataFrame(asked, "qid INT, query STRING")
    index, scores = stored(spark, articles, str(tmp_path / "index")), ranked(data, 2, asked)
    for size, base in ((3, 0), (10, 5)):
        assert hits(se.search_field(articles, queries, "text", size, base, index=index)) == top(scores, size, base)


def test_few_documents_are_scored_for_a_rare_and_a_common_term(spark, small_blocks, tmp_path):
    rows = [(n, "", "common " + ("rare " if n % 500 == 7 else "") + " ".join(f"f{k}" for k in range(n % 9))) for n in range(3000)]
    articles = spark.createDataFrame(rows, "aid BIGINT, title STRING, text STRING")
    index = stored(spark, articles, str(tmp_path / "index"))
    queries = spark.createDataFrame([(1, "rare common"), (2, "rare"), (3, "nothing")], "qid INT, query STRING")
    assert hits(se.search_field(articles, queries, "text", 5, index=index)) == top(ranked(rows, 2, [(1, "rare common"), (2, "rare")]), 5)
    effort = {r["qid"]: (r["postings"], r["scored"]) for r in se.search_effort(queries, index, 5).collect()}
    assert effort[1][0] == 3006 and effort[1][1] < 100 and effort[2][0] == 6 and 3 not in effort


def test_index_after_inserts_and_deletes_equals_a_new_one(spark, small_blocks, tmp_path):
    data, articles = skewed(spark, 300, 9)
    asked = [(n, f"w{n} w{39 - n} w0") for n in range(20)]
    queries = spark.createDataFrame(asked, "qid INT, query STRING")
    path = str(tmp_path / "index")
    ids = lambda *n: spark.createDataFrame([(k,) for k in n], "aid BIGINT")
    se.write_index(se.field_index(articles.filter("aid < 150"), "text"), path)
    base = sorted(p for p in (tmp_path / "index").rglob("*.parquet"))

    def check(alive, size=4):
        index = se.read_index(spark, path)
        scores = ranked([r for r in data if r[0] in alive], 2, asked)
        assert hits(se.search_field(articles, queries, "text", size, index=index)) == top(scores, size)

    se.insert_into_index(se.field_index(articles.filter("aid >= 200"), "text"), path)
    check({*range(150), *range(200, 300)})
    se.delete_from_index(ids(*range(20, 60), 250, 250, 9999, None), path)
    alive = {*range(20), *range(60, 150), *range(200, 250), *range(251, 300)}
    check(alive)
    se.insert_into_index(se.field_index(articles.filter("aid between 30 and 40 or aid between 150 and 199"), "text"), path)
    alive |= {*range(30, 41), *range(150, 200)}
    se.delete_from_index(ids(35), path)
    check(alive - {35}, size=400)
    assert all(p.exists() for p in base)
    se.blocks.compact(spark, path)
    check(alive - {35})
    assert se.read_index(spark, path).deleted is None
    se.delete_from_index(ids(), path)
    se.insert_into_index(se.field_index(articles.filter("aid = 35"), "text"), path)
    check(alive)


def test_index_of_nothing(spark, tmp_path):
    _, articles = make(spark)
    index = stored(spark, articles.limit(0), str(tmp_path / "index"))
    queries = spark.createDataFrame(QUERIES, "qid INT, query STRING")
    assert hits(se.search_field(articles, queries, "text", index=index)) == []
    se.insert_into_index(se.field_index(articles, "text"), str(tmp_path / "index"))
    data, _ = make(spark)
    index = se.read_index(spark, str(tmp_path / "index"))
    assert hits(se.search_field(articles, queries, "text", index=index)) == top(ranked(data, 2, QUERIES), 10)


def like(term, value):
    """SQL LIKE of ``%term%`` as a pattern of Python."""
    return re.search("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in term.lower()), value.lower(), re.S)


@pytest.mark.parametrize("is_stored", [False, True])
def test_substring_search_by_brute_force(spark, tmp_path, is_stored):
    rng = random.Random(21)
    values = ["".join(rng.choice("abcÄ%_\\") for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    rows = [(n % 50, rng.choice(["title", "body"]), rng.choice(values)) for n in range(600)] + [(51, "title", None), (52, "body", "")]
    features = spark.createDataFrame(rows, "id BIGINT, type STRING, value STRING")
    asked = [(n, " ".join(rng.choice(["", "@"]) + "".join(rng.choice("abcä%_\\") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 3)))) for n in range(120)]
    asked += [(200, "%"), (201, "@___"), (202, "@"), (203, "  \t"), (204, ""), (205, None), (206, "zzz"), (207, "a b"), (208, "@%_%_")]
    index = None
    if is_stored:
        se.substrings.write_substring_index(se.substrings.substring_index(features), str(tmp_path / "index"))
        index = se.substrings.read_substring_index(spark, str(tmp_path / "index"))
    got = se.search_like(features, spark.createDataFrame(asked, "qid INT, query STRING"), index).collect()
    want = set()
    for qid, query in asked:
        tests = [(t, w.lstrip("@") if w[0] == "@" else w) for w in (query or "").split() for t in (("title",) if w[0] == "@" else ("title", "body"))]
        for doc in {r[0] for r in rows}:
            if tests and all(any(r[0] == doc and r[1] == t and r[2] is not None and like(w, r[2]) for r in rows) for t, w in tests):
                want.add((qid, doc))
    assert sorted(map(tuple, got)) == sorted(want)


def test_many_queries_do_not_meet_all_blocks_of_a_shared_word(spark, small_blocks, monkeypatch, tmp_path):
    rows = [(n, f"document n{n}", "") for n in range(200)]
    articles = spark.createDataFrame(rows, "aid BIGINT, title STRING, text STRING")
    asked = [(n, title) for n, title, _ in rows]
    index, met = stored(spark, articles, str(tmp_path / "index"), "title"), []
    heads = se.blocks._heads

    def counted(*args):
        met.append(heads(*args).count())
        return heads(*args)

    monkeypatch.setattr(se.blocks, "_heads", counted)
    monkeypatch.setattr(se.blocks, "TOGETHER", 100, raising=False)
    found = hits(se.search_title(articles, spark.createDataFrame(asked, "qid INT, query STRING"), size=1, index=index))
    assert found == top(ranked(rows, 1, asked), 1)
    assert sum(met) <= 3 * len(asked)


@pytest.mark.parametrize("size", [1, 4, 60])
def test_very_many_queries_equal_full_scoring(spark, small_blocks, monkeypatch, tmp_path, size):
    monkeypatch.setattr(se.blocks, "TOGETHER", 5)
    monkeypatch.setattr(se.blocks, "TRIED", 2)
    monkeypatch.setattr(se.blocks, "CHOICE", 3)
    data, articles = skewed(spark, 300, size)
    rng = random.Random(size)
    asked = [(n, " ".join(f"w{int(40 * rng.random() ** 2)}" for _ in range(rng.randrange(0, 7)))) for n in range(40)]
    asked += [(100 + r[0], r[2]) for r in data[::10]]
    queries, path = spark.createDataFrame(asked, "qid INT, query STRING"), str(tmp_path / "index")
    stored(spark, articles, path)
    se.delete_from_index(articles.filter("aid % 7 = 3"), path)
    alive = [r for r in data if r[0] % 7 != 3]
    assert not se.blocks._prepared(se.read_index(spark, path), se._query_terms(queries)).repeats
    assert hits(se.search_field(articles, queries, "text", size, index=se.read_index(spark, path))) == top(ranked(alive, 2, asked), size)


def test_titles_that_share_most_words_are_not_scored_for_each_other(spark, small_blocks, monkeypatch, tmp_path):
    """As addresses do; each shared word is a title of its own too, where it has a high score."""
    monkeypatch.setattr(se.blocks, "TOGETHER", 100)
    shared = ["https", "example", "com", "en", "page", *(f"host{n}" for n in range(7))]
    titles = [*shared, *(f"x{n}" for n in range(600)), *(f"https host{n % 7} example com en n{n} page" for n in range(150))]
    rows = [(n, title, "") for n, title in enumerate(titles)]
    articles = spark.createDataFrame(rows, "aid BIGINT, title STRING, text STRING")
    asked = [(n, title) for n, title, _ in rows]
    queries, index = spark.createDataFrame(asked, "qid INT, query STRING"), stored(spark, articles, str(tmp_path / "index"), "title")
    assert hits(se.search_title(articles, queries, size=1, index=index)) == top(ranked(rows, 1, asked), 1)
    scored = sum(r["scored"] for r in se.search_effort(queries, index, 1).collect())
    assert scored <= 10 * len(asked)


@pytest.mark.parametrize("together", [0, 1_000])
def test_repeated_ids_add_up(spark, small_blocks, monkeypatch, tmp_path, together):
    rows = [(n, "", f"w{n % 3} " + "all " * (n % 5)) for n in range(30)] + [(7, "", "w1 w1 all all"), (8, "", "w2 other other")]
    articles = spark.createDataFrame(rows, "aid BIGINT, title STRING, text STRING")
    queries = spark.createDataFrame([(1, "w1 all"), (2, "w2 other")], "qid INT, query STRING")
    monkeypatch.setattr(se.blocks, "TOGETHER", together, raising=False)
    index = stored(spark, articles, str(tmp_path / "index"))
    # Both rows of an id have their terms in each of its entries.
    assert len(index.postings.selectExpr("inline(entries)").filter("id = 8").collect()) >= 3
    got = se.search_field(articles.dropDuplicates(["aid"]), queries, "text", 50, index=index).collect()
    assert len({(r["qid"], r["aid"]) for r in got}) == len(got)


def test_index_moves_texts_not_postings(spark):
    """Words are unfolded and counted where the block is: nothing moves after that, and the rows are sorted once."""
    _, articles = make(spark)
    texts = se.field_index(articles, "text").texts
    lengths = texts.select("id", F.size(se.match_tokens(F.col("text"))).alias("len"))
    with se.blocks.sorted_groups(spark):
        made = se.blocks._blocked_texts(texts, lengths, 3).sortWithinPartitions("term", "block")
        made.collect()
        plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    above = plan[: plan.index("Generate explode")]
    assert "Exchange" not in above and above.count("Sort [") == 1
    rows = made.selectExpr("term", "inline(entries)").collect()
    kept = se.postings(articles, "text").collect()
    assert sorted((r["id"], r["term"], r["len"], r["tf"]) for r in rows) == sorted((r["id"], r["term"], r["len"], r["tf"]) for r in kept)
