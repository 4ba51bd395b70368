"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formsift.llm.common import settled


def star(links: DataFrame, large: bool) -> DataFrame:
    """Tie each node's larger (or own and smaller) neighbours to the smallest that it knows."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.filter("b < a")
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    kept = both.filter("b > a") if large else both
    tied = kept.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    if not large:
        tied = tied.unionByName(least.select("a", F.col("least").alias("b")))
    return tied.filter("a > b").distinct()


def state(links: DataFrame) -> tuple[int, int, int]:
    """How many links there are, a hash of them all, and how many nodes are tied twice, or tied and tied to."""
    ties = links.select("a", F.xxhash64("a", "b").cast("decimal(38,0)").alias("h"), F.lit(1).alias("link")).unionByName(
        links.select(F.col("b").alias("a")).distinct().select("a", F.lit(0).cast("decimal(38,0)").alias("h"), F.lit(0).alias("link")))
    nodes = ties.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("h"), F.sum("link").alias("links"))
    found = nodes.agg(F.sum("links"), F.sum("h"), F.count_if(F.col("n") > 1)).first()
    return found[0] or 0, found[1] or 0, found[2]


def components(links: DataFrame, name: str) -> DataFrame:
    """``node, component`` of every node of the links ``a, b``; a component is its smallest node.

    The links after each round are written to the shared folder, which cuts the lineage. A round
    shortens all paths, so that the number of rounds grows with the logarithm of the longest.
    """
    now = settled(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), name)
    before, seen = None, state(now)
    # Done when every node is tied once and to nothing that is tied itself, or nothing changed.
    while seen[2] and seen != before:
        now = settled(star(star(now, True), False), name)
        before, seen = seen, state(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
