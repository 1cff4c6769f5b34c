"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.session import cut_lineage

MAX_ROUNDS = 60


def _checksum(links: DataFrame) -> tuple:
    """Number and order-free hash of the links; decimal, because a sum of hashes exceeds 64 bits."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected(links: DataFrame) -> DataFrame:
    """Node and root, the smallest node reachable, for every node of `links` (a, b) that is not its own root.

    Rounds of large star and small star: each links the neighbours of a node
    to its smallest neighbour, first the larger ones, then the smaller ones. The
    minimum of a node is a grouped aggregate, so a node with a large share of
    the links costs one row per task; every round is written to the shared
    folder. Ends when a round changes nothing.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    edges = cut_lineage(edges)
    seen = _checksum(edges)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("low"))
        lowest = lowest.select("a", F.least("a", "low").alias("low"))
        large = both.join(lowest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = cut_lineage(large.filter("a > b").distinct())
        floor = large.groupBy("a").agg(F.min("b").alias("low"))
        pairs = large.join(floor, "a")
        small = pairs.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            floor.select("a", F.col("low").alias("b"))
        )
        edges = cut_lineage(small.filter("a > b").distinct())
        now = _checksum(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
