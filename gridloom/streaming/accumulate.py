"""Overlap-add over a stream of tile contributions.

The reverse chain is iterative and stays a batch loop; what can stream is the accumulation: sums of
w, w*w, w*mu and w*n by pixel are kept as state, and either fusion rule is read off them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "tile_id int, c int, y int, x int, w double, mu double, n double"


def sums(contributions: DataFrame) -> DataFrame:
    """c, y, x with the four sums and the number of tiles; batch or streaming."""
    w = F.col("w")
    return contributions.groupBy("c", "y", "x").agg(F.sum(w).alias("wsum"), F.sum(w * w).alias("w2sum"), F.sum(w * F.col("mu")).alias("wmu"), F.sum(w * F.col("n")).alias("wn"), F.count("*").alias("tiles"))


def fused(totals: DataFrame, rule: str = "sdvc") -> DataFrame:
    """c, y, x, v from sums."""
    noise = F.col("wn") / (F.sqrt("w2sum") if rule == "sdvc" else F.col("wsum"))
    return totals.select("c", "y", "x", (F.col("wmu") / F.col("wsum") + noise).alias("v"))


def accumulate(contributions: DataFrame, name: str, checkpoint: str):
    """Starts a query that keeps the sums of a stream in the table `name` (complete mode) until what is there is read."""
    return sums(contributions).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
