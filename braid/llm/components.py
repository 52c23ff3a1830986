"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import written


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """Per node ``u`` the least of itself and its neighbours; partial aggregation takes hubs."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))


def components(edges: DataFrame) -> DataFrame:
    """(u, v) to (node, component): the least node that each node of an edge reaches.

    Each round links every node to the least node near it, first for larger
    neighbours, then for smaller ones; no neighbourhood is gathered in one row.
    Rounds grow with the logarithm of the number of nodes. Nulls are no nodes;
    loops and repeated edges change nothing; no edges give no rows.
    """
    now = written(edges.where("u IS NOT NULL AND v IS NOT NULL").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).select("u", "v").distinct(), "edges")
    before = None
    while True:
        both = now.union(now.select("v", "u"))
        large = both.join(_least_neighbour(both), "u").where("v > u OR v = m").select(F.greatest("v", "u").alias("x"), "u", "v", "m")
        large = large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.where("v < u")
        least = _least_neighbour(down)
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("v < u").distinct()
        now = written(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
