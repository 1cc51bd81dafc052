"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, component) of every node of `edges` (u, v long), component being its least reachable node.

    Each round is written to the shared folder. The rounds grow with the logarithm of the longest
    chain, not with the rows; no node's neighbours are ever gathered into one value, and the join
    with the least neighbour is one that Spark can split for a hot node. Without edges: no rows.
    """
    tidy = lambda e: e.where("u <> v").distinct()
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now, k = scratch.keep(tidy(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))), f"{name}-0"), 0
    seen = mark(now)
    while seen[0]:
        k += 1
        now = scratch.keep(tidy(_small_star(tidy(_large_star(now)))), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        before, seen = seen, mark(now)
        if seen == before:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.select("v", "v").distinct())
