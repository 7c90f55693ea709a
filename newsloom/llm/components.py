"""Connected components of link tables, distributed and cut by written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for every node that has a link.

    Every node first takes its smallest neighbour below it as root; chains of roots are followed by doubling; links
    are then drawn between roots, and every root takes the smallest one it meets. Only minima are aggregated, per
    task before the shuffle, so a node with very many links costs one row per task. It ends when no link joins two roots.
    """
    edges = stored(links.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).distinct(), "links")
    roots = stored(edges.select(F.col("y").alias("node"), F.col("x").alias("root")).union(edges.select(F.col("x"), F.col("x")))
                   .groupBy("node").agg(F.min("root").alias("root")), "roots")
    while True:
        roots = followed(roots)
        edges = stored(edges.join(roots.select(F.col("node").alias("x"), F.col("root").alias("rx")), "x")
                       .join(roots.select(F.col("node").alias("y"), F.col("root").alias("ry")), "y")
                       .where("rx <> ry").select(F.least("rx", "ry").alias("x"), F.greatest("rx", "ry").alias("y")).distinct(), "links")
        if edges.isEmpty():
            return roots
        meets = edges.groupBy(F.col("y").alias("root")).agg(F.min("x").alias("low"))
        roots = stored(roots.join(meets, "root", "left").select("node", F.coalesce("low", "root").alias("root")), "roots")


def followed(roots: DataFrame) -> DataFrame:
    """Let every node point at the end of its chain of roots; each pass doubles the steps."""
    while True:
        hop = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
        ahead = stored(roots.join(hop, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        roots = ahead.select("node", "root")
        if ahead.where("moved").isEmpty():
            return roots
