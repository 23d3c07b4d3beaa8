"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import forget, staged


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (node, root): root is the smallest node reachable; nodes of any type that has an order. Nodes without a link to another are absent.

    Alternates large-star and small-star steps, each written to the shared folder, until the edge set stands still
    (a logarithmic number of rounds in practice). Null ends and self links are dropped; repeated links count once.
    """
    edge = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = edge.unionByName(edge.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = staged(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        seen = Observation()
        before, edge = edge, staged(small.distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("hash")), "small")
        forget(before, large)
        now = seen.get
        if now == mark:
            break
        mark = now
    return edge.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edge.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
