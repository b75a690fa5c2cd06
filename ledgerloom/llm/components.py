"""Connected components of links in Spark, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.shared import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node`` and the smallest ``root`` it reaches, for every node of ``links`` (a, b).

    Each round hangs the neighbours of a node on the smallest of them, first the
    larger ones, then the smaller ones. Rounds grow with the logarithm of the
    longest chain; a node with very many links is only aggregated and joined, so
    adaptive execution can split it. Self-links and repeated links do no harm.
    """
    edges = stored(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    seen = _state(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).filter("b > a").select(
            F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("u"))
        edges = stored(
            small.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        state = _state(edges)
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
