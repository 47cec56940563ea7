"""Connected components of links by alternating stars, with joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trackguard.session import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u hangs on u's smallest neighbour."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """The smaller neighbours of u, and u, hang on the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionAll(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) between nodes of any orderable type: (node, component) for every node that has a link; the component is its
    smallest node. Every round is written to the shared folder; the number of rounds grows with the logarithm of the size."""
    edges = stored(links.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u != v").distinct())
    state = _state(edges)
    while True:
        edges = stored(_small(_large(edges)))
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
