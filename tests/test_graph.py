import random

import pytest
from pyspark.sql import functions as F

from folioscope import session
from folioscope.operators import graph as gr


def pairs(df):
    return sorted(map(tuple, df.collect()))


def reach_sinks(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    found = set()
    for start in out:
        seen, todo = set(), [start]
        while todo:
            for nxt in out.get(todo.pop(), ()):
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        found |= {(start, z) for z in seen if z not in out}
    return sorted(found)


@pytest.mark.parametrize("edges", [
    [(1, 2), (2, 3), (3, 4), (10, 11), (11, 10), (12, 10), (13, 13)],
    [(n, n + 1) for n in range(37)],
    [(1, 2), (1, 3), (2, 4), (3, 5), (5, 6), (2, 7), (7, 2)],
    [(n, 1000) for n in range(100)] + [(1000, 1001), (1001, 1002)],
    [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)],
    [(5, 5)],
])
def test_closure_equals_search(spark, edges):
    df = spark.createDataFrame(edges, "src BIGINT, dst BIGINT")
    assert pairs(gr.redirect_closure(df, rows_per_slot=10)) == reach_sinks(edges)


def test_closure_on_random_graphs(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 60), rng.randint(0, 90)) for _ in range(90)]
    df = spark.createDataFrame(edges + [(7, None)], "src BIGINT, dst BIGINT")
    assert pairs(gr.redirect_closure(df)) == reach_sinks(edges)


def test_sinks_and_degrees(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (1, 3)], "src BIGINT, dst BIGINT")
    assert pairs(gr.redirect_sinks(df)) == [(3,)]
    assert pairs(gr.degree(df)) == [(1, 3), (2, 1), (3, 0)]


def test_final_links_keep_links_without_redirect(spark):
    links = spark.createDataFrame([(1, 2, 0.1), (1, 2, 0.5), (1, 3, 0.2)], "src BIGINT, dst BIGINT, frac DOUBLE")
    ends = spark.createDataFrame([(2, 9), (2, 8)], "src BIGINT, dst BIGINT")
    assert pairs(gr.join_final_links(links, ends, rows_per_slot=1)) == [
        (1, 2, 8, 0.1), (1, 2, 8, 0.5), (1, 2, 9, 0.1), (1, 2, 9, 0.5), (1, 3, 3, 0.2),
    ]


@pytest.mark.parametrize("edges_per_slot", [5_000_000, 3])
def test_page_rank_equals_power_iteration(spark, edges_per_slot):
    rng = random.Random(9)
    links = [(rng.choice([0, 0, rng.randint(0, 30)]), rng.randint(0, 40), rng.random()) for _ in range(300)]
    links = [(s, d, f) for s, d, f in links if s != 17]
    nodes = sorted({s for s, _, _ in links} | {d for _, d, _ in links})
    rank = {n: 1 / len(nodes) for n in nodes}
    for _ in range(6):
        got = dict.fromkeys(nodes, 0.0)
        totals = dict.fromkeys(nodes, 0.0)
        for s, d, f in links:
            totals[s] += 2 / (1 + 3 * f)
        for s, d, f in links:
            got[d] += rank[s] * (2 / (1 + 3 * f)) / totals[s]
        loose = sum(rank[n] for n in nodes if totals[n] == 0)
        rank = {n: 0.15 / len(nodes) + 0.85 * (got[n] + loose / len(nodes)) for n in nodes}
    df = spark.createDataFrame(links, "src BIGINT, dst BIGINT, frac DOUBLE")
    ranks = gr.page_rank(df, rounds=6, edges_per_slot=edges_per_slot)
    out = {r["id"]: r["rank"] for r in ranks.collect()}
    assert out == pytest.approx(rank, rel=1e-9)
    assert sum(out.values()) == pytest.approx(1.0)
    best = sorted(rank, key=lambda n: (-rank[n], n))[:3]
    assert [r["id"] for r in gr.top_ranked(ranks, 3).collect()] == best
    page = spark.createDataFrame([(n, f"t{n}") for n in nodes], "id BIGINT, title STRING")
    assert {r["id"] for r in gr.top_pages(page, ranks, 3).collect()} == set(best)


def test_links_of_undecoded_text(spark):
    schema = "id BIGINT, ns INT, title STRING, redirect STRING, text STRING"
    text = "x&nbsp;[[b c|B]] [[#top]] [[d_e#f|g]] [[|no]] [[ h]]"
    pages = spark.createDataFrame(
        [(1, 0, "A", None, text), (2, 0, "R", "A", "[[A]]"), (3, 1, "T", None, "[[A]]"), (4, 0, "N", None, None)], schema
    )
    for decode, seen in ((True, text.replace("&nbsp;", " ")), (False, text)):
        expected = [("A", " h", seen.index("[[ h")), ("A", "B c", seen.index("[[b")), ("A", "D_e", seen.index("[[d"))]
        links = gr.extract_links(pages, decode=decode)
        assert pairs(links.select("src", "dst", "pos")) == expected
        assert all(r["frac"] == r["pos"] / len(text) for r in links.collect())


def test_ranks_settle(spark):
    links = spark.createDataFrame([(1, 2, 0.0), (2, 3, 0.5), (3, 1, 0.2), (3, 4, 0.9), (5, 1, 0.1)], "src long, dst long, frac double")
    settled = {r["id"]: r["rank"] for r in gr.page_rank(links, tolerance=1e-4).collect()}
    long = {r["id"]: r["rank"] for r in gr.page_rank(links, rounds=25).collect()}
    assert all(abs(settled[k] - long[k]) < 0.01 for k in long) and abs(sum(settled.values()) - 1) < 1e-6


def test_no_round_moves_the_edges(spark):
    """The edges of a join on their buckets are read without an exchange or a sort."""
    from folioscope.session import bucketed

    rows = spark.range(3000).selectExpr("id % 70 as src", "cast(id % 2 as int) as slot", "id as dst", "1.0d as w")
    edges, drop = bucketed(rows, "src", "slot", name="test-edges")
    try:
        giving = spark.range(70).selectExpr("id as src", "explode(sequence(0, 1)) as slot", "0.5d as unit")
        joined = edges.join(giving.hint("shuffle_hash"), ["src", "slot"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        below = plan[plan.index("ShuffledHashJoin") :]
        assert below.count("Exchange hashpartitioning") == 1 and "Sort " not in below and "Bucketed: true" in below
        assert joined.agg({"unit": "sum"}).first()[0] == 1500
    finally:
        drop()
    assert "test_edges" not in str(spark.catalog.listTables())


def test_chains_and_forks_together(spark):
    """Long chains into forks, forks into chains, cycles through forks, and several ways to one sink."""
    rng = random.Random(12)
    for _ in range(3):
        edges = [(n, n + 1) for n in range(0, 40)] + [(100 + n, 101 + n) for n in range(20)] + [(40, 100), (40, 7), (120, 200), (120, 201), (200, 300), (201, 300)]
        edges += [(rng.randrange(400, 440), rng.randrange(400, 460)) for _ in range(40)]
        df = spark.createDataFrame(edges, "src BIGINT, dst BIGINT")
        assert pairs(gr.redirect_closure(df, rows_per_slot=rng.choice([5, 1000]))) == reach_sinks(edges)


@pytest.mark.parametrize("in_parts", [False, True])
def test_link_ids_of_titles_that_repeat_or_are_unknown(spark, in_parts):
    rng = random.Random(3)
    titles = [None, "the", "the", "x", *(f"t{n}" for n in range(20))]
    named = [(t, n) for n, t in enumerate(titles)]
    some = lambda: rng.choice(["the", "the", "gone", *titles])
    links = [(some(), some(), rng.random()) for _ in range(400)]
    page = spark.createDataFrame(named, "title STRING, id BIGINT")
    df = spark.createDataFrame(links, "src STRING, dst STRING, frac DOUBLE").repartition(3)
    df = session.in_parts(df, "links", 50) if in_parts else df
    ids = gr.join_link_ids(df, page)
    assert (session.PART in ids.columns) == in_parts
    expected = [(a, b, f) for s, d, f in links for x, a in named for y, b in named if s and s == x and d and d == y]
    assert pairs(ids.select("src", "dst", "frac")) == sorted(expected)
    final = gr.join_final_links(ids, spark.createDataFrame([(1, 7), (2, 7), (2, 8), (None, 9)], "src BIGINT, dst BIGINT"))
    ends = {1: [7], 2: [7, 8]}
    assert pairs(final) == sorted((a, b, e, f) for a, b, f in expected for e in ends.get(b, [b]))


def test_edges_for_ranks_move_once(spark):
    rows = spark.createDataFrame([(n % 7, n % 3, n % 5, 1.0) for n in range(200)], "src INT, slot INT, dst INT, w DOUBLE")
    plans = []

    def summed(df):
        out = df.groupBy("src", "slot", "dst").agg(F.sum("w").alias("w"))
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    edges, drop = session.bucketed(rows, "src", "slot", name="edges", change=summed)
    assert plans[0].count("Exchange") == 1
    assert pairs(edges) == pairs(rows.groupBy("src", "slot", "dst").agg(F.sum("w")))
    drop()
