"""Resampling as weighted aggregation: a table of weights for an axis, joined and summed, once an axis.

A weight table has a few rows for each output position of an axis (its size is known from the
two lengths, and it is broadcast only below a limit), so each pass is one join and one aggregation
with partial sums; the first pass already shrinks what the second exchanges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Largest weight table, in rows, that is broadcast (some 10 MB of the driver, several at a time); beyond it the join is by
#: exchange, also where Spark takes the compressed table for small.
BROADCAST_ROWS = 100_000
CUBIC = -0.75


def area_weights(spark: SparkSession, n: int, m: int) -> DataFrame:
    """d, k, wt: the share of input cell k in output cell d when n cells become m by area."""
    f = n / m
    lo, hi = F.col("d") * f, (F.col("d") + 1) * f
    cells = spark.range(m).select(F.col("id").cast("int").alias("d"))
    cells = cells.withColumn("k", F.explode(F.sequence(F.floor(lo).cast("int"), F.least(F.lit(n - 1), F.ceil(hi) - 1).cast("int"))))
    share = (F.least(hi, F.col("k") + 1.0) - F.greatest(lo, F.col("k").cast("double"))) / f
    return cells.select("d", "k", share.alias("wt")).where("wt > 1e-12")


def cubic_weights(spark: SparkSession, n: int, m: int) -> DataFrame:
    """d, k, wt: four-tap cubic weights (a = -0.75) at half-pixel centres; taps outside repeat the edge."""
    p = (F.col("d") + 0.5) * n / m - 0.5
    taps = spark.range(m).select(F.col("id").cast("int").alias("d")).withColumn("tap", F.explode(F.sequence(F.lit(-1), F.lit(2))))
    taps = taps.withColumns({"p": p, "at": F.floor(p) + F.col("tap")}).withColumn("u", F.abs(F.col("p") - F.col("at")))
    u, a = F.col("u"), CUBIC
    kernel = F.when(u <= 1, (a + 2) * u * u * u - (a + 3) * u * u + 1).when(u < 2, a * u * u * u - 5 * a * u * u + 8 * a * u - 4 * a).otherwise(0.0)
    at = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.col("at"))).cast("int")
    return taps.groupBy("d", at.alias("k")).agg(F.sum(kernel).alias("wt"))


def _pass(pixels: DataFrame, weights: DataFrame, axis: str, rows: int, after) -> DataFrame:
    held = F.broadcast(weights) if rows <= BROADCAST_ROWS else weights.hint("merge")
    keys = [c for c in pixels.columns if c not in (axis, "v")]
    out = pixels.join(held.withColumnRenamed("k", axis), axis).groupBy(*keys, "d").agg(after(F.sum(F.col("v") * F.col("wt"))).alias("v"))
    return out.withColumnRenamed("d", axis)


def _resize(pixels: DataFrame, kind, size: tuple[int, int], to: tuple[int, int], per_output: float, after) -> DataFrame:
    spark, (h, w), (mh, mw) = pixels.sparkSession, size, to
    rows = lambda n, m: int(m * (n / m + 2) if per_output == 0 else m * per_output)
    out = _pass(pixels, kind(spark, w, mw), "x", rows(w, mw), lambda v: v)
    return _pass(out, kind(spark, h, mh), "y", rows(h, mh), after)


def _keep(v: Column) -> Column:
    return v


def down_area(pixels: DataFrame, size: tuple[int, int], to: tuple[int, int], after=_keep) -> DataFrame:
    """pixels (..., y, x, v) of a grid `size` (h, w) averaged by area to the grid `to`; after is applied to each value."""
    return _resize(pixels, area_weights, size, to, 0, after)


def up_cubic(pixels: DataFrame, size: tuple[int, int], to: tuple[int, int], after=_keep) -> DataFrame:
    """pixels of a grid `size` resized to the grid `to` by cubic interpolation."""
    return _resize(pixels, cubic_weights, size, to, 4, after)


def degrade(pixels: DataFrame, size: tuple[int, int], low: tuple[int, int], byte: bool = False) -> DataFrame:
    """Down by area to `low` and back up by cubic interpolation. With `byte`, each step rounds and stays in 0..255."""
    after = (lambda v: F.rint(F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0)))) if byte else _keep
    return up_cubic(down_area(pixels, size, low, after), low, size, after)


def low_frequency_projection(sr: DataFrame, obs: DataFrame, size: tuple[int, int], scale: int) -> DataFrame:
    """sr with its low frequencies replaced by those of obs, held to 0..255.

    Both are cut to the common top left extent by the join. As resampling is linear, the
    difference is resampled once instead of either image. Whole images are never broadcast, however well they compress.
    """
    h, w = size
    low = max(1, h // scale), max(1, w // scale)
    keys = [c for c in sr.columns if c != "v"]
    both = sr.join(obs.withColumnRenamed("v", "o").hint("merge"), keys).where((F.col("y") < h) & (F.col("x") < w))
    gap = both.select(*keys, (F.col("o") - F.col("v")).alias("v"))
    moved = up_cubic(down_area(gap, size, low), low, size).withColumnRenamed("v", "gap")
    return both.join(moved.hint("merge"), keys).select(*keys, F.least(F.greatest(F.col("v") + F.col("gap"), F.lit(0.0)), F.lit(255.0)).alias("v"))


def decimate(pixels: DataFrame, size: tuple[int, int], most: int = 2048, bands: int = 3) -> DataFrame:
    """The nearest-cell preview of the first bands, its longer side at most `most`."""
    h, w = size
    s = max(1.0, max(h, w) / most)
    mh, mw = max(1, round(h / s)), max(1, round(w / s))
    # an input cell is kept if it is the centre's cell of some output cell
    spot = lambda c, n, m: F.floor((F.col(c) + F.lit(1.0)) * m / n - 0.5 - 1e-9).cast("int")
    centre = lambda d, n, m: F.floor((d + 0.5) * n / m).cast("int")
    out = pixels.where(F.col("c") <= bands).withColumns({"dy": spot("y", h, mh), "dx": spot("x", w, mw)})
    out = out.where((centre(F.col("dy"), h, mh) == F.col("y")) & (centre(F.col("dx"), w, mw) == F.col("x")) & (F.col("dy") >= 0) & (F.col("dx") >= 0))
    return out.select("c", F.col("dy").alias("y"), F.col("dx").alias("x"), "v")


def overview(pixels: DataFrame, level: int, byte: bool = False) -> DataFrame:
    """Means of level x level cells: c, oy, ox, v; with `byte` rounded half to even."""
    mean = F.rint(F.avg("v")) if byte else F.avg("v")
    return pixels.groupBy("c", F.expr(f"y div {level}").cast("int").alias("oy"), F.expr(f"x div {level}").cast("int").alias("ox")).agg(mean.alias("v"))


def mean_scale(width: Column, height: Column, ow: Column, oh: Column) -> Column:
    """The scale of an overview of ow x oh cells: the mean of those of its two axes."""
    return (width / ow + height / oh) / 2


def choose_overview(levels: DataFrame, target: float = 16) -> DataFrame:
    """Of levels (path, level, scale) the one of each path whose scale is nearest the target; the first of equals.

    `fit` says whether it is within half of the target, bounds excluded.
    """
    order = Window.partitionBy("path").orderBy(F.abs(F.col("scale") - target), "level")
    best = levels.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")
    return best.withColumn("fit", F.abs(F.col("scale") - target) / target < 0.5)


def fractal_noise(spark: SparkSession, size: int, bands: int = 1, octaves: int = 7, seed: int = 0) -> DataFrame:
    """c, y, x, v: keyed noise on grids of 4, 8, 16 ... cells, each resized and halved in strength, brought to 0..1."""
    from gridloom.functions.columns import uniform

    total = None
    for k in range(octaves):
        n = 1 << (k + 2)
        cells = spark.range(bands * n * n).select(F.expr(f"cast(id div {n * n} as int) + 1").alias("c"), F.expr(f"cast(id div {n} % {n} as int)").alias("y"), F.expr(f"cast(id % {n} as int)").alias("x"))
        octave = up_cubic(cells.withColumn("v", uniform(F.col("c"), F.col("y"), F.col("x"), seed=seed + k) * 0.5**k), (n, n), (size, size))
        total = octave if total is None else total.unionByName(octave)
    summed = total.groupBy("c", "y", "x").agg(F.sum("v").alias("v"))
    ends = summed.groupBy("c").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return summed.join(F.broadcast(ends), "c").select("c", "y", "x", F.coalesce((F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.lit(0.0)).alias("v"))  # ends: a row a band


def synthetic_scene(spark: SparkSession, size: int = 2048, octaves: int = 7, seed: int = 0) -> DataFrame:
    """A three-band scene of whole numbers 20..235: 0.75 structure, common to the bands, and 0.25 noise of each band."""
    tints = (1.00, 0.92, 0.78)
    shape = fractal_noise(spark, size, 1, octaves, seed).select("y", "x", F.col("v").alias("s"))
    own = fractal_noise(spark, size, 3, octaves, seed + 100)
    tint = F.element_at(F.array(*map(F.lit, tints)), F.col("c"))
    v = (0.75 * F.col("s") + 0.25 * F.col("v")) * tint * 255
    return own.join(shape, ["y", "x"]).select("c", "y", "x", F.rint(F.least(F.greatest(v, F.lit(20.0)), F.lit(235.0))).alias("v"))
