"""Connected components of a graph that is given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernwalk.llm.common import cut, released

MAX_ROUNDS = 60


def _large_star(e: DataFrame) -> DataFrame:
    both = e.selectExpr("stack(2, a, b, b, a) AS (a, b)")
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _stars(e: DataFrame) -> bool:
    """Whether each node of ``e(a, b)`` is either the end ``b`` of edges or the end ``a`` of one."""
    ends = e.selectExpr("stack(2, a, 1, b, 0) AS (node, up)")
    return not ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > least").count()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; a component is its smallest node.

    Large-star and small-star rounds (Kiveris et al. 2014) alternate until each
    node has one edge to the least of its component. Each round is cut off in the
    shared folder, and what the one before shuffled is let go. A node's
    neighbours are never gathered: their minimum is pre-aggregated, then joined.
    Loops and null ends are left out.
    """
    e = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    for _ in range(MAX_ROUNDS):
        if _stars(e):
            break
        e = cut(_small_star(_large_star(e)))
        released(e.sparkSession)
    else:
        raise RuntimeError(f"components didn't settle in {MAX_ROUNDS} rounds")
    roots = e.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
