"""Connected components by alternating large and small stars; no task gathers a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import cut


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(v, c): every vertex of `edges` (a, b) and the smallest vertex that it reaches."""
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    before = None
    for _ in range(most):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b")
        now = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components didn't converge")
    return now.select(F.col("a").alias("v"), F.col("b").alias("c")).unionByName(now.select(F.col("b").alias("v"), F.col("b").alias("c")).distinct())
