"""Connected components of a list of links, by alternating stars.

Each round hangs every node's larger neighbours on its least neighbour, then
does the same with the smaller ones; rounds are written to the shared folder.
A node with many links is an aggregate with partial sums and a join whose hot
key Spark may split, never a list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node in ``links`` (a, b), root being the least node reachable."""
    edges = settle(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        edges = settle(_small_star(_large_star(edges)), "stars")
        # unchanged once every node hangs on one root: then these sums stand still
        state = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.max(F.xxhash64("a", "b"))).first()
        if state == mark:
            break
        mark = state
    members = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return members.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
