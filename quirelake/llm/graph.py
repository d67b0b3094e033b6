"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the least node of each component, for every node of edges (a, b). Loops, repeats and both directions are fine; nulls are ignored.

    Large-star and small-star rounds (each node passes its neighbours the least node it knows) until nothing changes; a handful for star-like graphs,
    at most logarithmic squared. Each step sums before it shuffles, joins by node (Spark splits skewed ones) and is written to the shared folder.
    """
    now = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = cut(now, "edges")
    before = None
    for _ in range(rounds):
        # Large star: neighbours larger than a node are tied to the least node around it.
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = cut(large, "large-star")
        # Small star: a node and its smaller neighbours are tied to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("a"), F.col("m").alias("b")).union(joined.select(F.col("b").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()
        now = cut(small, "small-star")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).head()
        # Done when each node has one edge and no node is both a child and a root.
        if state[0] == state[2] and (before == tuple(state) or now.join(now.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty()):
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
