"""Connected components of a graph given as a table of edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return scratch.joined(both.where("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = scratch.joined(down, least, "a")
    return tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for each node of the edges (a, b) that isn't its component's least node itself. Loops and nulls are left out."""
    now = scratch.written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(most):
        last, now = now, scratch.written(_small_star(_large_star(now)), "stars")
        scratch.dropped(last)
        # Stars stay as they are; the sums tell when nothing has moved.
        told = now.agg(F.count("*"), F.coalesce(F.sum(F.col("b") % 1_000_003), F.lit(0)), F.coalesce(F.sum(F.xxhash64("a", "b") % 1_000_003), F.lit(0))).first()
        if told == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = told
    raise RuntimeError("the components have not settled")
