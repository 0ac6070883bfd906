"""Connected components by alternating large-star and small-star rounds over staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.llm.staging import Stage


def components(edges: DataFrame, stage: Stage, name: str) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b long): root is the least node it reaches.

    Each round moves every edge twice and keeps their number; rounds grow with the logarithm
    of the longest path.  A node's edges are only aggregated (to their least) and joined back.
    """
    e = stage.put(f"{name}-0", edges.select("a", "b").filter("a <> b").distinct())
    i, last = 0, None
    while True:
        # Large star: each larger neighbour of a node goes to the least of its neighbourhood.
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours go to the least of them.
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        i += 1
        e = stage.put(f"{name}-{i}", small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        stage.drop(f"{name}-{i - 1}")
        if tuple(now) == last:
            break
        last = tuple(now)
    return e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
