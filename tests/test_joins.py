import random

import pytest
from pyspark.sql import functions as F

from folioscope import session
from folioscope.operators import joins


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    rng = random.Random(5)
    keys = ["hot"] * 200 + [f"k{rng.randint(0, 40)}" for _ in range(150)] + [None] * 5
    big = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "k STRING, n INT")
    small = spark.createDataFrame(
        [("hot", 1), ("hot", 2), (None, 3)] + [(f"k{x}", x) for x in range(0, 60, 3)] + [("k3", 99)], "k STRING, v INT"
    )
    plain = big.join(small, "k", how)
    salted = joins.salted_join(big, small, "k", how, rows_per_slot=20)
    assert salted.columns == plain.columns
    assert rows(salted) == rows(plain)
    counts = big.groupBy("k").agg(F.count("*").alias("rows"))
    assert rows(joins.salted_join(big, small, "k", how, 20, counts)) == rows(plain)


def test_only_small_tables_are_broadcast(spark):
    df = spark.range(1000).withColumn("t", F.lit("x" * 100))
    assert joins.is_small(df)
    assert not joins.is_small(df, max_rows=999)
    assert not joins.is_small(df, max_bytes=100_000)
    hinted = joins.broadcast_if_small(df)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in hinted


@pytest.mark.parametrize("base, size", [(0, 3), (3, 4), (0, 1000), (95, 10), (990, 30)])
def test_top_per_group(spark, monkeypatch, base, size):
    rng = random.Random(6)
    data = [(rng.choice("aaab"), rng.randint(0, 50), n) for n in range(1500)]
    df = spark.createDataFrame(data, "g STRING, s INT, id INT")
    expected = []
    for g in "ab":
        ranked = sorted((r for r in data if r[0] == g), key=lambda r: (-r[1], r[2]))
        expected += [(*r, n + 1) for n, r in enumerate(ranked)][base : base + size]
    for pruned in (1000, 1):
        monkeypatch.setattr(joins, "PRUNED_RANK", pruned)
        got = joins.top_per_group(df, ["g"], [F.desc("s"), F.col("id")], size, base, slots=7)
        assert rows(got) == sorted(map(repr, expected))


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("rows_of_part", [1, 7, 1_000])
def test_looking_up_leaves_rows_in_their_parts(spark, how, rows_of_part):
    keys = ["the"] * 60 + [f"k{n % 9}" for n in range(60)] + [None] * 5 + ["nowhere"] * 5
    rows = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "k STRING, n INT").repartition(3)
    table = spark.createDataFrame([("the", 1), ("the", 2), (None, 3), *((f"k{n}", n) for n in range(9))], "k STRING, v INT")
    parts = session.in_parts(rows, "rows", rows_of_part)
    assert parts.groupBy(session.PART).count().agg(F.max("count")).first()[0] <= rows_of_part
    with session.parts_kept(spark):
        joined = joins.looked_up(parts, table, "k", how)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        found = sorted(map(str, joined.select("k", "n", "v").collect()))
    assert found == sorted(map(str, rows.join(table, "k", how).select("k", "n", "v").collect()))
    # The first side of the join is the scan of the rows, with no exchange over it.
    assert "Exchange" not in plan.split("ShuffledHashJoin")[1].split("+- Exchange")[0]
    assert "FileScan" in plan.split("ShuffledHashJoin")[1].split("+- Exchange")[0]
