"""Connected components of a graph given as links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brandsieve.llm.common import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours to the least of a node's neighbourhood: the larger ones (large) or all lower ones."""
    if large:
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = ordered.groupBy("a").agg(F.min("b").alias("m"))
    others = ordered.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of ``edges`` (a, b longs); the component is its least node.

    Each round is checkpointed; the number of rounds grows with the logarithm of the graph's size, and
    no node's neighbours are gathered in one place: minima are taken on the map side. Links from a node
    to itself and repeated links change nothing. No links give an empty result.
    """
    now = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        now = checkpointed(_star(_star(now, large=True), large=False))
        seen = now.agg(F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionAll(nodes.select(F.col("component").alias("node"), "component").distinct())
