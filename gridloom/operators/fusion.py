"""Fusion of overlapping tile contributions into one value a pixel.

Contributions are rows (c, y, x, w, mu, n): weight, mean and noise term of one tile at one pixel.
Both rules are one aggregation with sums only, so partial sums are made before the exchange
and maps of the geometry never have to be joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("c", "y", "x")


def geometry_maps(covered: DataFrame) -> DataFrame:
    """wsum and w2sum (sums of w and w*w over the covering tiles) of each pixel (y, x)."""
    return covered.groupBy("y", "x").agg(F.sum("w").alias("wsum"), F.sum(F.col("w") * F.col("w")).alias("w2sum"))


def _carried(carry: tuple[str, ...]) -> list:
    """Columns that are the same in all contributions of a pixel, such as the condition."""
    return [F.max(c).alias(c) for c in carry]


def fuse_average(parts: DataFrame, keys: tuple[str, ...] = KEYS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Weighted average of mu + n."""
    return parts.groupBy(*keys).agg((F.sum(F.col("w") * (F.col("mu") + F.col("n"))) / F.sum("w")).alias("v"), *_carried(carry))


def fuse_variance_preserving(parts: DataFrame, keys: tuple[str, ...] = KEYS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Weighted average of mu, and noise scaled so that independent unit noise keeps unit variance."""
    w = F.col("w")
    return parts.groupBy(*keys).agg((F.sum(w * F.col("mu")) / F.sum(w) + F.sum(w * F.col("n")) / F.sqrt(F.sum(w * w))).alias("v"), *_carried(carry))


def fuse_with_maps(parts: DataFrame, maps: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The variance-preserving rule in its per-tile form, with the geometry maps joined; equal to the one above.

    Maps have a row for every pixel. They compress so well that Spark would take those of a large scene for small
    and send them to the driver as a broadcast, so the join is by exchange.
    """
    s = F.sqrt("w2sum")
    share = F.col("w") / s * (F.col("mu") + F.col("n")) + (1 - F.col("wsum") / s) * F.col("w") / F.col("wsum") * F.col("mu")
    return parts.join(maps.hint("merge"), ["y", "x"]).groupBy(*keys).agg(F.sum(share).alias("v"))


FUSIONS = {"avg": fuse_average, "sdvc": fuse_variance_preserving}
