"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from advertide.session import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour."""
    both = edges.union(edges.select(F.col("low").alias("high"), F.col("high").alias("low"))).toDF("node", "other")
    least = both.groupBy("node").agg(F.min("other").alias("other_min"))
    least = least.select("node", F.least("node", "other_min").alias("low"))
    tied = both.where("other > node").join(least, "node").select(F.col("other").alias("high"), "low")
    return tied.distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    least = edges.groupBy("high").agg(F.min("low").alias("least"))
    others = edges.join(least, "high").where("low > least").select(F.col("low").alias("high"), F.col("least").alias("low"))
    return others.union(least.select("high", F.col("least").alias("low"))).distinct()


def connected(edges: DataFrame, name: str, most_rounds: int = 60) -> DataFrame:
    """The least node each node is connected with: ``node, component``; nodes without an edge are left out.

    ``edges`` has two columns of longs in any order; loops, nulls and repeats do no
    harm. A round is two grouped minima and two joins over the edges, written to
    the shared folder; no node, edge list or component passes through the driver.
    Hot nodes meet partial minima and joins that can be split.
    """
    left, right = (F.col(c) for c in edges.columns)
    current = edges.select(F.greatest(left, right).alias("high"), F.least(left, right).alias("low"))
    current = stage(current.where((left != right) & left.isNotNull() & right.isNotNull()).distinct(), name)
    seen = None
    for _ in range(most_rounds):
        state = current.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            return current.select(F.col("high").alias("node"), F.col("low").alias("component")).union(
                current.select(F.col("low"), F.col("low")).distinct()
            )
        seen = state
        current = stage(_small_star(_large_star(current)), name)
    raise RuntimeError(f"{name}: components did not settle in {most_rounds} rounds")
