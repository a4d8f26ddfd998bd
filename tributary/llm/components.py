"""Connected components of a graph given as links, by alternating large-star and small-star steps.

Each step links nodes to the smallest neighbour known; minima are pre-aggregated
before the shuffle, and those of nodes with very many neighbours are handed out by broadcast (of a bounded number
of nodes). Every round is written to the shared folder, so a lost
executor costs no earlier round. The number of rounds grows with the logarithm of
the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_by_size, stash


def _large(e: DataFrame, n: int) -> DataFrame:
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("size"))
    return joined_by_size(both.where("b > a"), least, "a", "size", n).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small(e: DataFrame, n: int) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("size"))
    handed = joined_by_size(down, least, "a", "size", n).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return handed.union(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of links (a, b: any ordered type).

    Links with a null end or from a node to itself are ignored; no links give no rows.
    """
    e = stash(links.select("a", "b").where("a != b").distinct())
    mark = _mark(e)
    while mark[0]:
        large = stash(_large(e, mark[0]))
        e = stash(_small(large, mark[0]))
        new = _mark(e)
        if new == mark:
            break
        mark = new
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
