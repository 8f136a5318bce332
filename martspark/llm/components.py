"""Connected components of an edge table, by rounds of joins and grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martspark.session import stage


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): every node of `edges` (a, b) that is not the least of its component, and the least one.

    Each round points the larger neighbours of a node, then the smaller ones, at the least it knows; the
    rounds grow with the logarithm of the component sizes. A round's edges are written to the shared
    folder, so a lost executor repeats one round at most. A node with very many neighbours is reduced by
    partial minima and met in a plain join, which Spark splits when it is skewed.
    """
    edges = stage(edges.where("a != b").distinct(), "edges")
    before = None
    while (now := _mark(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Now every edge leads from a larger to a smaller node.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stage(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
