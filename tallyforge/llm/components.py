"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, drop


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) for every id of the undirected edges (a, b).

    Large star: each neighbour above a node is linked to the node's smallest
    neighbour. Small star: each one below it is. Both keep the components, and
    when nothing changes every node hangs from its smallest one. The smallest
    neighbour is an aggregate with partial sums, and a node of very many edges
    joins it by a join whose large partitions Spark splits; no task holds a
    component. Only a count and a checksum come to the driver. Loops, repeated
    edges and null ends fall out; without edges the result is empty.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = checkpoint(e)
    state = _state(e)
    while state[0]:
        before = e
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        up = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(low, "u")
        stars = down.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = checkpoint(stars.distinct())
        drop(before)
        now = _state(e)
        if now == state:
            break
        state = now
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
