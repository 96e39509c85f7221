"""Connected components of a link table by alternating large-star and small-star steps, each staged."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, stage


def _lowest(edges: DataFrame) -> DataFrame:
    """node, low: the smallest node among node and its neighbours, from edges (u, v) that hold both directions."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: for every node that has a link, the smallest node of its component.

    Rounds grow with the logarithm of the longest path, and a round's rows with the links. Nulls link nothing.
    """
    pairs = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = stage(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == before or not mark["n"]:
            break
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where("v > u").join(_lowest(both), "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        # small star: the lower neighbours of u, and u itself, to the lowest of them
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v")))
        after = stage(small.where("u <> v").distinct(), "edges")
        discard(now)
        now = after
    roots = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
