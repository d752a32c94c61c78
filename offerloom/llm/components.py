"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round rewires every node to the smallest neighbour it knows, first its larger
neighbours, then itself with the smaller ones; the edges end as stars around the
smallest id of each component. Nothing is collected; every round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """From edges (u, v): a staged table (node, component) of every node of an edge between two nodes."""
    now = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    state = _state(now)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.union(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        step = stage(large, "edges")
        least = step.groupBy("u").agg(F.min("v").alias("m"))
        small = step.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        after = stage(small, "edges")
        new = _state(after)
        unstage(step, now)
        now = after
        if new == state:
            break
        state = new
    out = stage(now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    unstage(now)
    return out
