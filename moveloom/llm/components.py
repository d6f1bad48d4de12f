"""Connected components of a graph given as rows of edges, by alternating star contractions.

Each round is two joins of edges with one minimum per node, so nothing is gathered per node and no edge
reaches the driver; the number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to the smallest of its neighbours and itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()


def components(scratch: Scratch, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (u, v) -> (node, component) for every node with an edge to another; component is its smallest node.

    An error if that takes more than max_rounds.
    """
    now = scratch.keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for done in range(max_rounds + 1):
        # done when each node has one smaller neighbour, which has none
        twice = now.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u")
        chained = now.join(now.select(F.col("u").alias("v")), "v", "left_semi").select("u")
        if not twice.union(chained).limit(1).count():
            break
        if done == max_rounds:
            raise RuntimeError(f"components not found within {max_rounds} rounds")
        after = scratch.keep(_small_star(_large_star(now)))
        scratch.drop(now)
        now = after
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
