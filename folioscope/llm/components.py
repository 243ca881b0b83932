"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hang every larger (``large``) or smaller neighbour of a node, and the node, on its smallest neighbour."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    hung = both.join(least, "a")
    if large:
        hung = hung.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        hung = hung.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return hung.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for the nodes of ``links`` (``a, b``); the component is its smallest node.

    Alternates the two star steps until nothing moves, which takes about log n rounds however the
    links lie. Each round is staged; only a count and a checksum come to the driver.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, before = stage(links, "links"), None
    while True:
        seen = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before or not seen[0]:
            break
        before = seen
        links = stage(_star(_star(links, True), False), "links")
    named = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return named.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
