"""Connected components of an edge table, by alternating star steps.

Each step sends a node's neighbours to the smallest of them; the two kinds of
step repeat until the edges are stars around each component's smallest node.
A node of any degree is handled by partial aggregation (its minimum) and a
join that adaptive execution splits.  Every round is written to the shared
folder, so neither lineage nor one executor's disk carries it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchwright.llm.common import stored


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that is not its component's smallest; edges: (a, b), in any direction."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    mark = None
    while True:
        edges = stored(small_star(large_star(edges)), "components")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now
