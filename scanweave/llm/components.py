"""Connected components by alternating star contractions.

Edges are rows; nothing is gathered on the driver. Each round joins the
edges with the least neighbour of their ends. The edges of a hub, a node with
very many of them, are dealt over several tasks for that join, and the number
of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.llm.common import dealt_join, written


def _with_least(edges: DataFrame) -> DataFrame:
    """``u, v, least``: each edge with the least neighbour of its ``u``."""
    return dealt_join(edges, edges.groupBy("u").agg(F.min("v").alias("least")), ["u"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of them."""
    joined = _with_least(edges)
    return (
        joined.select(F.col("v").alias("u"), F.col("least").alias("v"))
        .unionByName(joined.select("u", F.col("least").alias("v")))
        .filter("u != v")
        .distinct()
    )


def _settled(edges: DataFrame) -> bool:
    """Whether every node is a root or has one edge, to a root."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root"))
    )
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root")).filter("up + root > 1").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``edges(u long, v long)``; the root is the least node reachable.

    Self links and repeated links are allowed; an empty input gives an empty result.
    """
    now = written(
        edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    while not _settled(now):
        larger = written(_large_star(now), "edges", now)
        now = written(_small_star(larger), "edges", larger)
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
