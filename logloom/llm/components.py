"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.session import staged


def _large_star(links: DataFrame) -> DataFrame:
    """Every node hands the smallest node of its neighbourhood to its larger neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("root").alias("b")).filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node hands its smallest smaller neighbour to the others and itself. Links run from larger to smaller."""
    least = links.groupBy("a").agg(F.min("b").alias("root"))
    inner = links.join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b"))
    return inner.unionByName(least.select("a", F.col("root").alias("b"))).filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` (smallest node reachable) of all nodes of ``links`` (columns ``a``, ``b``) but the roots.

    Rounds are written to the shared folder; they end when links no longer
    change, after about the logarithm of the longest path. An empty table has no
    node.
    """
    now = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen or mark[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark
        now = staged(_small_star(_large_star(now)))
