"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal.session import checkpointed


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour, itself included."""
    near = _both_ways(edges)
    least = near.groupBy("_a").agg(F.min("_b").alias("_m")).withColumn("_m", F.least("_a", "_m"))
    return near.filter("_b > _a").join(least, "_a").select(F.col("_b").alias("_a"), F.col("_m").alias("_b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least of them."""
    down = edges.select(F.greatest("_a", "_b").alias("_a"), F.least("_a", "_b").alias("_b"))
    least = down.groupBy("_a").agg(F.min("_b").alias("_m"))
    others = down.join(least, "_a").select(F.col("_b").alias("_a"), F.col("_m").alias("_b"))
    return others.unionByName(least.select("_a", F.col("_m").alias("_b")))


def _normal(edges: DataFrame) -> DataFrame:
    return edges.filter("_a != _b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """For edges (_a, _b) of integers: _node and _root, its least reachable node, for all but the roots.

    Both steps are joins with an aggregate, so no node's neighbours are gathered in one
    place; the number of rounds grows with the logarithm of the largest component.
    """
    current, seen = checkpointed(_normal(edges)), None
    while True:
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("_a", "_b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return current.select(F.col("_a").alias("_node"), F.col("_b").alias("_root"))
        seen = state
        current = checkpointed(_normal(_small_star(_normal(_large_star(current)))))
