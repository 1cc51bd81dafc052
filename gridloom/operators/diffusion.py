"""The noise schedule and the algebra of forward and reverse diffusion steps, as projections.

A schedule is a dimension table of a row a step; its length is a parameter, so it is broadcast.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.columns import gaussian, uniform

#: Fixed values of the schedule.
STEPS, BETA_FIRST, BETA_LAST, VARIANCE_FLOOR = 2000, 1e-6, 1e-2, 1e-20


def schedule(spark: SparkSession, steps: int = STEPS, precision: str = "f64") -> DataFrame:
    """t, beta, alpha, acp, acp_prev and what follows from them, for t = 0 .. steps - 1.

    `f64` is a plan of window functions over the table of steps; `f32` is worked out in single
    precision but for the shifted product, which is double, and then rounded to single throughout.
    """
    if precision == "f32":
        return _single(spark, steps)
    order = Window.orderBy("t")  # a row a step: this table never grows with data
    t = spark.range(steps).select(F.col("id").cast("int").alias("t"))
    step = (BETA_LAST - BETA_FIRST) / max(1, steps - 1)
    base = t.withColumn("beta", F.lit(BETA_FIRST) + F.col("t") * step).withColumn("alpha", 1 - F.col("beta"))
    base = base.withColumn("acp", F.product("alpha").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("acp_prev", F.lag("acp", 1, 1.0).over(order))
    b, a, p, q = (F.col(c) for c in ("beta", "alpha", "acp", "acp_prev"))
    return base.withColumns({
        "sqrt_acp": F.sqrt(p), "sqrt_1m": F.sqrt(1 - p), "log_1m": F.log(1 - p), "sqrt_recip": F.sqrt(1 / p), "sqrt_recipm1": F.sqrt(1 / p - 1),
        "post_var": b * (1 - q) / (1 - p), "post_logvar": F.log(F.greatest(b * (1 - q) / (1 - p), F.lit(VARIANCE_FLOOR))),
        "coef1": b * F.sqrt(q) / (1 - p), "coef2": (1 - q) * F.sqrt(a) / (1 - p),
    })


def _single(spark: SparkSession, steps: int) -> DataFrame:
    f, one = np.float32, np.float32(1)
    beta = np.linspace(BETA_FIRST, BETA_LAST, steps, dtype=f)
    alpha = one - beta
    acp = np.cumprod(alpha, dtype=f)
    prev = np.concatenate([[1.0], acp[:-1].astype(np.float64)])
    var = beta * (1.0 - prev) / (one - acp)
    columns = {
        "beta": beta, "alpha": alpha, "acp": acp, "acp_prev": prev, "sqrt_acp": np.sqrt(acp), "sqrt_1m": np.sqrt(one - acp), "log_1m": np.log(one - acp),
        "sqrt_recip": np.sqrt(one / acp), "sqrt_recipm1": np.sqrt(one / acp - one), "post_var": var, "post_logvar": np.log(np.maximum(var, VARIANCE_FLOOR)),
        "coef1": beta * np.sqrt(prev) / (one - acp), "coef2": (1.0 - prev) * np.sqrt(alpha) / (one - acp),
    }
    rows = [(t, *(float(f(v[t])) for v in columns.values())) for t in range(steps)]
    return spark.createDataFrame(rows, "t int, " + ", ".join(f"{c} double" for c in columns))


def level(acp: Column) -> Column:
    """The continuous noise level that a predictor is told at a step."""
    return F.sqrt(acp)


def noised(x0: Column, level: Column, noise: Column) -> Column:
    """Forward noising at a level."""
    return level * x0 + F.sqrt(1 - level * level) * noise


def start_from_noise(x: Column, noise: Column, row: str = "s") -> Column:
    """The clean value that a state and predicted noise imply."""
    return F.col(f"{row}.sqrt_recip") * x - F.col(f"{row}.sqrt_recipm1") * noise


def clamp(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(-1.0)), F.lit(1.0))


def posterior_mean(x0: Column, x: Column, row: str = "s") -> Column:
    """Mean of the next state given the clean value and the state."""
    return F.col(f"{row}.coef1") * x0 + F.col(f"{row}.coef2") * x


def noise_term(z: Column, row: str = "s") -> Column:
    """Noise of the next state; none at the last step."""
    return F.when(F.col(f"{row}.t") == 0, 0.0).otherwise(z * F.exp(F.col(f"{row}.post_logvar") / 2))


def reverse_step(rows: DataFrame, steps: DataFrame, predicted: Column, z: Column) -> DataFrame:
    """rows (..., t, x) with x0, mu and n: one reverse step, its mean and noise apart. predicted may use the schedule as s.*."""
    joined = rows.alias("r").join(F.broadcast(steps.alias("s")), F.col("r.t") == F.col("s.t"))  # a row a step
    x0 = clamp(start_from_noise(F.col("r.x"), predicted))
    return joined.select("r.*", x0.alias("x0"), posterior_mean(x0, F.col("r.x")).alias("mu"), noise_term(z).alias("n"))


def reverse_sample(rows: DataFrame, steps: DataFrame, predicted: Column, z: Column) -> DataFrame:
    """reverse_step() with `sample`, its mean and noise together."""
    return reverse_step(rows, steps, predicted, z).withColumn("sample", F.col("mu") + F.col("n"))


def stacked(cond: DataFrame, state: DataFrame, bands: int) -> DataFrame:
    """The input of a predictor as pixels: the condition's bands, then those of the state with numbers beyond them."""
    return cond.select("c", "y", "x", "v").unionByName(state.select((F.col("c") + bands).alias("c"), "y", "x", "v"))


def oracle_noise(cond: Column, x: Column, row: str = "s") -> Column:
    """The closed-form predictor that takes the condition for the clean value."""
    return (x - F.col(f"{row}.sqrt_acp") * cond) / F.col(f"{row}.sqrt_1m")


def zero_noise(cond: Column, x: Column, row: str = "s") -> Column:
    """The predictor that sees no noise."""
    return F.lit(0.0)


EXPRESSIONS = {"oracle": oracle_noise, "zero": zero_noise}


def initial_state(pixels: DataFrame, seed: int = 0, carry: bool = False) -> DataFrame:
    """c, y, x, v: keyed standard normal noise for every pixel; with `carry` also cond, the pixel's own value."""
    noise = gaussian(F.col("c"), F.col("y"), F.col("x"), seed=seed).alias("v")
    return pixels.select("c", "y", "x", noise, *([F.col("v").alias("cond")] if carry else []))


def training_pairs(samples: DataFrame, steps: DataFrame, batch: Column, seed: int = 0) -> DataFrame:
    """samples (sample, v, ...) with t, level, noise and noisy: one t for a batch, a level for each sample.

    t is 1 .. steps; the level lies evenly between those of t - 1 and t.
    """
    total = steps.count()
    levels = steps.select((F.col("t") + 1).alias("t"), F.sqrt("acp_prev").alias("__a"), F.sqrt("acp").alias("__b"))
    drawn = samples.withColumn("batch", batch).withColumn("t", (F.floor(uniform(F.col("batch"), seed=seed) * total) + 1).cast("int"))
    drawn = drawn.join(F.broadcast(levels), "t").withColumn("level", F.col("__a") + uniform(F.col("sample"), F.col("batch"), seed=seed + 1) * (F.col("__b") - F.col("__a")))
    keys = [F.col(c) for c in ("sample", "c", "y", "x") if c in samples.columns]
    return drawn.drop("__a", "__b").withColumn("noise", gaussian(*keys, seed=seed + 2)).withColumn("noisy", noised(F.col("v"), F.col("level"), F.col("noise")))


def mean_absolute_error(rows: DataFrame, a: str, b: str) -> DataFrame:
    """loss: the mean of |a - b|."""
    return rows.agg(F.avg(F.abs(F.col(a) - F.col(b))).alias("loss"))
