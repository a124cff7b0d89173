"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a partial aggregation and a join that deals out the neighbours of a hub; nothing is collected but whether all edges are stars,
which ends the rounds. Each round's edges are written to the shared folder, so the lineage stays short and a lost executor
costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, written


def _linked_to_least(edges: DataFrame) -> DataFrame:
    """Large star: every larger neighbour of u is linked to the least of u and its neighbours."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return spread_join(both.where("v > u"), least, "u", ["v"]).select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()


def _smaller_to_least(edges: DataFrame) -> DataFrame:
    """Small star: the smaller neighbours of u, and u, are linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = spread_join(down, least, "u", ["v"]).select(F.col("m").alias("a"), F.col("v").alias("b"))
    return moved.union(least.select("m", "u")).toDF("a", "b").where("a <> b").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node with a smaller neighbour has that one neighbour alone, so that no step would change an edge."""
    ends = edges.select(F.col("b").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("a", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 or below = 1 and above = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) to one row (node, root) per node that has an edge to another; root is the least node reachable."""
    now = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not _stars(now):
        now = written(_smaller_to_least(_linked_to_least(now)), "edges")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select("a", "a").distinct())
