"""Connected components by alternating stars, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variorum.llm._shared import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has a link and isn't the smallest of its component.

    Each round halves distances, so the rounds grow as the logarithm of the longest path; each round's edges are
    written to the shared folder, and only their count and checksum come to the driver. Minima are combined before
    they are shuffled, and joins are equi-joins whose hot keys adaptive execution splits.
    """
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a != b").distinct()
    edges = materialize(edges, "edges")
    before, now = None, _state(edges)
    while now != before:
        edges = materialize(_small_star(_large_star(edges)), "edges")
        before, now = now, _state(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
