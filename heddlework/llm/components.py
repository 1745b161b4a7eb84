"""Connected components of an edge table, by alternating star contractions.

Each round replaces edges so that every node points to smaller nodes until all point to the least
node of their component (large-star, then small-star). The number of rounds grows with the logarithm
of the longest path. A node with many neighbours is reduced to a minimum in parts before the
shuffle; the join that hands the minimum out again has plain exchanges on both sides, which adaptive
execution splits when one node dominates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b) with a > b; large: each node's larger neighbours move to its least, else its smaller ones and itself do."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
    moved = both.join(least, "u")
    moved = moved.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else moved.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b); root is the least node of its component."""
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    # Done when every node points to one other node, and that one to none.
    while edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count() or edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count():
        edges = cut(_star(_star(edges, True), False), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
