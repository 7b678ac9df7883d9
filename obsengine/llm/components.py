"""Connected components of a distributed edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsengine.llm.common import join_skewed, remove, stored


def _with_least(edges: DataFrame, used: list[DataFrame]) -> DataFrame:
    """edges (u, v) with m, the smallest v of u. Hubs are counted by the same aggregate and not gathered."""
    least = stored(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
    used.append(least)
    return join_skewed(edges, least, "u").withColumn("m", F.least("u", "m"))


def _large_star(edges: DataFrame, used: list[DataFrame]) -> DataFrame:
    """Each node's larger neighbours go to its smallest neighbour (itself included). edges: u > v, without repeats."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, used).filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, used: list[DataFrame]) -> DataFrame:
    """Each node's smaller neighbours, and itself, go to the smallest of them."""
    near = _with_least(edges, used)
    return near.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (smallest node of its component) for every node that has an edge.

    edges: u, v of one comparable type; loops, repeats and nulls are left out. Each round is written to the shared
    folder, so neither lineage nor a lost executor holds it up. A round reads and writes no more rows than there are
    edges; minima are aggregated before the shuffle, so a hub isn't gathered anywhere. An empty list gives no rows."""
    now = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        used = [now]
        half = stored(_large_star(now, used), "half")
        now = stored(_small_star(half, used), "edges")
        remove(half, *used)
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = seen
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
