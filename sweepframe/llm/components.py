"""Connected components of links, by large-star and small-star rounds, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame) -> DataFrame:
    """One round over edges ``(u, v)`` with ``v < u``: all neighbours move to the least one, twice."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.where(F.col("u") != F.col("v")).distinct()
    root = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(root, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(root.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)`` but the roots; the root is the least node of its component.

    Nodes are longs. The number of rounds grows with the logarithm of the longest chain; a round's result is
    a table, so a lost executor repeats one round at most.
    """
    ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    current, mark = stored(ordered, "links"), None
    while True:
        new = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark or new[0] == 0:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = new
        current = stored(_star(current), "links")
