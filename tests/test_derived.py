import random

from pyspark.sql import functions as F

from folioscope.registry.derived import WIKI_STEPS, derived_wiki
from folioscope.session import spread


def test_wiki_equals_its_steps(spark):
    rng = random.Random(3)
    parts = ["a", "ab", "Éclair", "x_1", "9", "the", " ", " ", ", ", ". ", ".\n", "\n", "[[", "]]", "_", "ß"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(400)] + [None, ""]
    plain = F.col("t")
    for pattern, change in WIKI_STEPS:
        plain = F.regexp_replace(plain, pattern, change.replace("\\1", "$1").replace("\\2", "$2"))
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING").select(plain.alias("plain"), derived_wiki(F.col("t")).alias("wiki"))
    assert all(r["plain"] == r["wiki"] for r in rows.collect())


def test_texts_are_spread_without_a_sort(spark):
    dealt = spread(spark.range(100, numPartitions=1).selectExpr("id", "repeat('x', 9) as text"))
    assert "RoundRobin" not in dealt._jdf.queryExecution().toString()
    assert dealt.rdd.getNumPartitions() > 1 and dealt.distinct().count() == 100
