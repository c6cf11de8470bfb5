"""Connected components of an edge table by alternating star rewrites; nodes and labels stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.session import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (two long columns): the component is its smallest node.

    Each round links every node's larger neighbours, then its smaller ones, to the smallest it knows; rounds needed grow with the
    logarithm of the longest path. A round's edges are written to the shared folder, so lineage stays short and a lost
    executor costs no earlier round. Rows with a null end, loops and repeated edges say nothing.
    """
    a, b = edges.columns
    now = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    while not _are_stars(now):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that no aggregate stands between the exchange and the join and a node of very many edges is split at run time.
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(lower.select("u", F.col("m").alias("v")))
        before, now = now, written(small.distinct(), "edges")
        discard(before, least)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller node at most, and none if another node has one to it: then the edges are the answer."""
    roles = edges.select(F.col("u").alias("x"), F.lit(1).alias("down")).unionAll(edges.select(F.col("v").alias("x"), F.lit(0).alias("down")))
    return roles.groupBy("x").agg(F.sum("down").alias("n"), F.min("down").alias("least")).where("n > 1 OR (n = 1 AND least = 0)").isEmpty()
