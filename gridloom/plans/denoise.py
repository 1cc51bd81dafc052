"""Joint denoising of a scene that is larger than any tile: every step denoises all tiles and fuses them.

One step is one plan: pixels are expanded into the tiles that cover them (arithmetic, no join), the
predictor gives mean and noise of each, and one aggregation fuses them. A step reads the fused state
of the one before, so the loop is on the driver; snapshots cut the lineage and make a run resumable.
The rows of the state carry the condition, so the scene is read once, not once a step; and as a step
groups by the keys by which its input is dealt already, only the first step after a snapshot exchanges rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.columns import byte_of_signed, gaussian, place_key, signed_unit
from gridloom.operators.diffusion import EXPRESSIONS, initial_state, reverse_step, schedule
from gridloom.operators.fusion import FUSIONS, geometry_maps
from gridloom.operators.tiling import covered
from gridloom.plans.config import InferConfig
from gridloom.sources.store import Snapshots, cached


def size_of(pixels: DataFrame) -> tuple[int, int]:
    """Height and width of a scene whose pixels begin at (0, 0)."""
    h, w = pixels.agg(F.max("y") + 1, F.max("x") + 1).first()
    return int(h), int(w)


def normalised(pixels: DataFrame, bands: tuple[int, ...], norm_range: tuple[float, float] | None = None) -> DataFrame:
    """The chosen bands in -1..1, over their common least and greatest value or a range that is given."""
    own = pixels.where(F.col("c").isin(*bands))
    if norm_range is not None:
        return own.withColumn("v", signed_unit(F.col("v"), *norm_range))
    ends = own.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return own.crossJoin(F.broadcast(ends)).withColumn("v", signed_unit(F.col("v"), F.col("lo"), F.col("hi"))).drop("lo", "hi")  # ends: one row


def with_condition(state: DataFrame, scene: DataFrame | None) -> DataFrame:
    """The state (c, y, x, v) with the scene's value as cond; as it is, if it has one."""
    return state if "cond" in state.columns else state.join(scene.withColumnRenamed("v", "cond"), ["c", "y", "x"])


def joint_step(state: DataFrame, scene: DataFrame | None, steps: DataFrame, t: int, shape: tuple[int, int], config: InferConfig) -> DataFrame:
    """The state (c, y, x, v, and cond if it came with it) after step t. The predictor is an expression of condition and state."""
    carry = ("cond",) if "cond" in state.columns else ()
    tiles = covered(with_condition(state, scene).withColumnRenamed("v", "x_t"), *shape, config.patch_size, config.stride).withColumn("t", F.lit(t))
    # x is the column's place on the grid and, in a reverse step, the state; they are told apart here
    tiles = tiles.withColumnRenamed("x", "gx").withColumnRenamed("x_t", "x")
    z = gaussian(F.col("c"), F.col("y"), F.col("gx"), place_key(F.col("h0"), F.col("w0"), 65537), seed=config.seed + 7919 * (t + 1))
    parts = reverse_step(tiles, steps.where(F.col("t") == t), EXPRESSIONS[config.predictor](F.col("r.cond"), F.col("r.x")), z)
    parts = parts.select("c", "y", F.col("gx").alias("x"), "w", "mu", "n", *carry)
    return FUSIONS[config.fusion](parts, carry=carry)


def is_saved(t: Column | int, every: int) -> Column | bool:
    """Whether the state of a step is one to save: every `every` steps, and the last, 0, always."""
    return t % every == 0


def stored_maps(spark: SparkSession, root: str, shape: tuple[int, int], size: int, stride: int) -> DataFrame:
    """y, x, wsum, w2sum of every pixel of a scene's grid, made once for a tiling. Fusion doesn't need them; other readers may."""
    h, w = shape
    grid = spark.range(h * w).select(F.expr(f"cast(id div {w} as int)").alias("y"), F.expr(f"cast(id % {w} as int)").alias("x"))
    about = {"shape": shape, "size": size, "stride": stride}
    return cached(spark, root, about, lambda: geometry_maps(covered(grid, h, w, size, stride)))


def network_step(state: DataFrame, scene: DataFrame | None, row: dict, shape: tuple[int, int], config: InferConfig, predict) -> DataFrame:
    """The state after the step of the schedule's line `row`, by any predictor of arrays: predict(cond, x, level)."""
    carry = ("cond",) if "cond" in state.columns else ()
    tiles = tile_rows(state, scene, shape, config.patch_size, config.stride)
    parts = tile_step(tiles, row, predict, sorted(config.bands), config.patch_size, config.seed + 7919 * (row["t"] + 1), carry)
    return FUSIONS[config.fusion](parts, carry=carry)


def predictor_of(spark, weights):
    """predict(cond, x, level) of (Shape, weights), which go to the executors once."""
    from gridloom.operators import unet

    held = spark.sparkContext.broadcast(weights)  # one file of weights
    return lambda cond, x, level: unet.predict(held.value[1], held.value[0], cond, x, level)


def denoise(pixels: DataFrame, config: InferConfig, folder: str, stop_after: int | None = None, weights=None, predict=None, saved=None) -> DataFrame:
    """The scene after all steps, in -1..1: c, y, x, v.

    Snapshots in `folder` are numbered by the next step to do. A run that finds some goes on from the
    least; a folder of other settings is refused. `stop_after` ends a run early, as an interruption would.
    With the predictor "network" every step is predict(cond, x, level) on the arrays of tiles: that of
    `weights`, (Shape, dict), if no other is given. saved(state, t) is called for every saved step.
    """
    spark = pixels.sparkSession
    shape = size_of(pixels)
    scene, steps = normalised(pixels, config.bands, config.norm_range), schedule(spark, config.steps, config.precision)
    if config.predictor == "network":
        if predict is None and weights is None:
            raise ValueError("the network needs weights")
        predict = predict or predictor_of(spark, weights)
        lines = {r.t: r.asDict() for r in steps.collect()}  # a row a step
    store = Snapshots(spark, folder)
    store.describe({"config": config, "shape": shape})
    done = store.committed()
    now = store.read(done[0]) if done else store.write(initial_state(scene, config.seed, carry=True), config.steps)
    at = done[0] if done else config.steps
    held = at
    for count, t in enumerate(range(at - 1, -1, -1), 1):
        now = network_step(now, None, lines[t], shape, config, predict) if config.predictor == "network" else joint_step(now, None, steps, t, shape, config)
        if is_saved(t, config.save_every) or (at - t) % 8 == 0 or count == stop_after:  # lineage never grows beyond eight steps
            now = store.write(now, t)
            store.drop(held)
            held = t
            if saved is not None and is_saved(t, config.save_every):
                saved(now.drop("cond"), t)
        if count == stop_after:
            break
    return now.drop("cond")


def as_bytes(state: DataFrame) -> DataFrame:
    """A state in -1..1 as 0..255."""
    return state.withColumn("v", byte_of_signed(F.col("v")))


def tile_rows(state: DataFrame, scene: DataFrame | None, shape: tuple[int, int], size: int, stride: int) -> DataFrame:
    """The second layout: a row a tile (h0, w0) with arrays x and cond in order of band, row and column.

    A tile holds a fixed number of pixels, so what is gathered has a bound.
    """
    own = with_condition(state, scene).withColumnRenamed("v", "x_t")
    cells = covered(own, *shape, size, stride).groupBy("h0", "w0").agg(F.array_sort(F.collect_list(F.struct("c", "i", "j", "x_t", "cond"))).alias("cells"))
    return cells.select("h0", "w0", F.col("cells.x_t").alias("x"), F.col("cells.cond").alias("cond"))


def tile_step(tiles: DataFrame, row: dict, predict, bands: list[int], size: int, seed: int = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """Contributions (c, y, x, w, mu, n, and cond if it is to be carried) of tile rows by any predictor: predict(cond, x, level) on (bands, size, size) arrays.

    row is the step's line of the schedule. Noise is keyed by tile and step, so a task that is run again
    gives the same rows.
    """
    c = size // 2
    i, j = np.mgrid[:size, :size]
    weight = (1 - np.hypot(i - c, j - c) / max(np.hypot(c, c), 1e-9) + 1e-4) if c else np.full((size, size), 1.0001)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for h0, w0, x, cond in zip(pdf["h0"], pdf["w0"], pdf["x"], pdf["cond"], strict=True):
                x, cond = (np.asarray(v, float).reshape(len(bands), size, size) for v in (x, cond))
                noise = predict(cond, x, float(np.sqrt(row["acp"])))
                x0 = np.clip(row["sqrt_recip"] * x - row["sqrt_recipm1"] * noise, -1, 1)
                mu = row["coef1"] * x0 + row["coef2"] * x
                z = np.random.default_rng([seed, row["t"], int(h0), int(w0)]).standard_normal(x.shape)
                n = z * np.exp(row["post_logvar"] / 2) if row["t"] else np.zeros_like(z)
                yield pd.DataFrame({"c": np.repeat(bands, size * size).astype(np.int32), "y": np.tile((h0 + i).ravel(), len(bands)).astype(np.int32), "x": np.tile((w0 + j).ravel(), len(bands)).astype(np.int32), "w": np.tile(weight.ravel(), len(bands)), "mu": mu.ravel(), "n": n.ravel()} | {k: cond.ravel() for k in carry})

    return tiles.mapInPandas(rows, "c int, y int, x int, w double, mu double, n double" + "".join(f", {k} double" for k in carry))


def sample_chain(samples: DataFrame, steps: DataFrame, predict, shape: tuple[int, int, int], seed: int = 0) -> DataFrame:
    """samples (sample, cond array) with `made`: the whole reverse chain of a single patch, inside one row; no exchange."""
    plan = [r.asDict() for r in steps.orderBy(F.desc("t")).collect()]  # a row a step

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for sample, cond in zip(pdf["sample"], pdf["cond"], strict=True):
                cond, rng = np.asarray(cond, float).reshape(shape), np.random.default_rng([seed, int(sample)])
                x = rng.standard_normal(shape)
                for r in plan:
                    x0 = np.clip(r["sqrt_recip"] * x - r["sqrt_recipm1"] * predict(cond, x, float(np.sqrt(r["acp"]))), -1, 1)
                    x = r["coef1"] * x0 + r["coef2"] * x
                    x = x + rng.standard_normal(shape) * np.exp(r["post_logvar"] / 2) if r["t"] else x
                made.append(x.ravel())
            yield pdf[["sample"]].assign(made=made)

    return samples.select("sample", "cond").mapInPandas(rows, "sample long, made array<double>")
