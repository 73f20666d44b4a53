"""Connected components by alternating large-star and small-star rounds on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import keep


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour, or the node."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    star = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.join(star, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    star = keep(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = down.join(star, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(star.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes on edges (u, v): the least node each can reach.

    Both are of one ordered type and not null. Nodes are dealt by hash, a node of many edges
    is joined to a single row of its own, and rounds (about the logarithm of a component's
    size) go through kept tables, so nothing is gathered and lineage stays short. The rows
    joined to are kept too: adaptive execution splits a hot key only where both sides of a
    join come straight from a shuffle.
    """
    now = keep(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    seen = None
    while True:
        now = keep(_small(_large(now)), "star")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        seen = state
