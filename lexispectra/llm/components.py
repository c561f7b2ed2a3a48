"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispectra.runtime import stage


def _staged(edges: DataFrame) -> tuple[DataFrame, tuple]:
    kept = stage(edges, "links")
    return kept, tuple(kept.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, root of every node of ``links`` (a, b) but the roots: root is the smallest node it can reach.

    Large stars tie a node's greater neighbours to its smallest one, small stars its
    smaller ones; the number of links never grows, and a few rounds leave stars
    alone. A hot node is a skewed join key, its minimum is combined before the
    shuffle. Links with a null end and loops are left out.
    """
    edges = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, state = _staged(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b"))
        edges, new = _staged(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        if new == state:
            break
        state = new
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
