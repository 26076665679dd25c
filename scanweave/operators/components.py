"""Connected components of a table of edges, by alternating star contractions.

Rounds grow with the logarithm of the longest chain; each one is a few joins of
the edges with the least neighbour of their ends, and leaves a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.tables import dealt_join, written


def _least(edges: DataFrame) -> DataFrame:
    return dealt_join(edges, edges.groupBy("u").agg(F.min("v").alias("least")), ["u"])


def _onto_least(edges: DataFrame) -> DataFrame:
    """Larger neighbours move to the least neighbour of a node, then a node and its smaller neighbours to the least of these."""
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    larger = _least(edges.unionByName(back)).filter("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v")).distinct()
    larger = written(larger, "edges")
    joined = _least(larger)
    own, others = joined.select("u", F.col("least").alias("v")), joined.select(F.col("v").alias("u"), F.col("least").alias("v"))
    return others.unionByName(own).filter("u != v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node is a root or has one edge, which leads to a root."""
    up = edges.select(F.col("u").alias("node"), F.lit(1).alias("ups"), F.lit(0).alias("root"))
    down = edges.select(F.col("v").alias("node"), F.lit(0).alias("ups"), F.lit(1).alias("root"))
    return up.unionByName(down).groupBy("node").agg((F.sum("ups") + F.max("root")).alias("n")).filter("n > 1").isEmpty()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, root`` of every row of ``nodes(node)``: the least node that ``edges(u, v)`` reach. Loops and repeated edges are allowed."""
    now = written(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _stars(now):
        now = written(_onto_least(now), "edges")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.select("node").distinct().join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
