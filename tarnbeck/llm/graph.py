"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnbeck.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root (the smallest node reachable) of every node of edges (a, b), by alternating large and small stars.

    Each round links nodes straight to smaller neighbours until stars are left; the rounds grow with the logarithm of
    the longest path. Edges stay in the cluster: a round is a written table, and the driver sees a count and a sum.
    """
    now = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "edges")
    mark = None
    while True:
        both = now.select("v", "u").union(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct(F.col("v").alias("v"), F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.v", "e.u")
        then = scratch.keep(small.where("v <> u").distinct(), "edges")
        seen = tuple(then.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        scratch.drop(now)
        now = then
        if seen == mark:
            break
        mark = seen
    out = now.select(F.col("v").alias("node"), F.col("u").alias("root"))
    out = out.union(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
    out._scratch_path = now._scratch_path
    return out
