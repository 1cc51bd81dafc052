"""Training and validation of a noise predictor as plans: samples, losses and gradients are tables, a step is one aggregation.

The predictor here is linear in the state, the condition and the noise level, so its gradient is a
sum that executors combine; what a deep network would learn is out of scope, the flow around it is not:
stored samples, steps over accumulated batches, a decoupled-decay optimiser, checkpoints of every epoch,
a table of metrics, validation by the whole reverse chain, and going on from the newest checkpoint.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.diffusion import mean_absolute_error, schedule, training_pairs
from gridloom.plans import dataset
from gridloom.plans.config import Config
from gridloom.plans.denoise import sample_chain
from gridloom.sources.store import Snapshots, fingerprint
from gridloom.sources.tiff import write_png

FEATURES = ("one", "state", "condition", "level", "level_state", "level_condition")
#: Fixed values of the optimiser: rates of its two running means, and what keeps its divisor from 0.
FIRST, SECOND, TINY = 0.9, 0.999, 1e-8
#: Most samples whose whole chain validation follows.
SHOWN = 8


def features(cond: Column, x: Column, level: Column) -> dict[str, Column]:
    return dict(zip(FEATURES, (F.lit(1.0), x, cond, level, level * x, level * cond), strict=True))


def linear_noise(weights: np.ndarray, cond: Column, x: Column, level: Column) -> Column:
    """The predicted noise as a column."""
    total = F.lit(0.0)
    for w, f in zip(weights.tolist(), features(cond, x, level).values(), strict=True):
        total = total + F.lit(w) * f
    return total


def predictor(weights: np.ndarray):
    """The same on arrays: predict(cond, x, level)."""
    a, b, c, d, e, f = weights.tolist()
    return lambda cond, x, level: a + b * x + c * cond + d * level + e * level * x + f * level * cond


def gradient(pairs: DataFrame, weights: np.ndarray) -> DataFrame:
    """One row: loss (mean |predicted - noise|), its derivative by each weight, n; of rows with cond, noisy, level, noise."""
    miss = linear_noise(weights, F.col("cond"), F.col("noisy"), F.col("level")) - F.col("noise")
    parts = features(F.col("cond"), F.col("noisy"), F.col("level"))
    rows = pairs.withColumn("__miss", miss)
    return rows.agg(F.avg(F.abs("__miss")).alias("loss"), *[F.avg(F.signum("__miss") * f).alias(k) for k, f in parts.items()], F.count("*").alias("n"))


@dataclass
class Optimiser:
    """Adam with decay apart from the gradient. Its state is small and lies on the driver."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))
    first: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))
    second: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))
    steps: int = 0

    def step(self, grad: np.ndarray, rate: float, decay: float) -> None:
        self.steps += 1
        self.weights = self.weights * (1 - rate * decay)
        self.first = FIRST * self.first + (1 - FIRST) * grad
        self.second = SECOND * self.second + (1 - SECOND) * grad * grad
        mean, spread = self.first / (1 - FIRST**self.steps), self.second / (1 - SECOND**self.steps)
        self.weights = self.weights - rate * mean / (np.sqrt(spread) + TINY)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, float(a), float(b), float(c), self.steps) for k, a, b, c in zip(FEATURES, self.weights, self.first, self.second, strict=True)], "name string, weight double, first double, second double, steps int")

    @classmethod
    def of(cls, table: DataFrame) -> Optimiser:
        rows = {r.name: r for r in table.collect()}
        return cls(*(np.array([rows[k][c] for k in FEATURES]) for c in ("weight", "first", "second")), rows[FEATURES[0]].steps)


def stored_samples(spark: SparkSession, root: str, index: DataFrame, rasters: DataFrame, pixels: DataFrame, config: Config) -> DataFrame:
    """Pixels of the samples of an index: part, sample, c, y, x, v (the target), cond; written once for these settings.

    A part holds about as many samples as one step of the optimiser takes, by a hash; a step reads the files of its part alone.
    """
    count = index.select("path", "x_offset", "y_offset").distinct().count()
    parts = max(1, round(count / (config.dataloader.batch_size * config.trainer.accumulate_grad_batches)))
    store = Snapshots(spark, f"{root}/{fingerprint({'config': config.dataset, 'parts': parts, 'patches': count})}", "samples")
    if 0 not in store.committed():
        key = F.xxhash64("path", "x_offset", "y_offset")
        rows = dataset.samples(dataset.patch_pixels(index, rasters, pixels, config.dataset), config.dataset)
        rows = rows.select(F.pmod(key, F.lit(parts)).cast("int").alias("part"), F.pmod(key, F.lit(1 << 30)).alias("sample"), "c", F.col("i").alias("y"), F.col("j").alias("x"), F.col("hr").alias("v"), F.col("lr").alias("cond"))
        rows.repartition("part", "sample").write.mode("overwrite").partitionBy("part").parquet(f"{store.root}/samples=0")
    return store.read(0)


def fit_epoch(samples: DataFrame, steps: DataFrame, optimiser: Optimiser, epoch: int, config: Config) -> list[tuple[int, float]]:
    """One pass over the parts of the samples, in an order of the epoch's own: (step, loss) of each. Every batch has one t."""
    t, size = config.trainer, config.dataloader.batch_size
    parts = sorted(r[0] for r in samples.select("part").distinct().collect())  # a row a step
    out = []
    for part in np.random.default_rng([t.seed, epoch]).permutation(parts).tolist():
        own = samples.where(F.col("part") == part)
        batch = F.pmod(F.xxhash64("sample", F.lit(epoch)), F.lit(t.accumulate_grad_batches)).cast("int") + F.lit((epoch * len(parts) + part) * t.accumulate_grad_batches)
        row = gradient(training_pairs(own.drop("part"), steps, batch, t.seed + 104729 * epoch), optimiser.weights).first()
        if row.n:
            optimiser.step(np.array([row[k] for k in FEATURES]), t.learning_rate, t.weight_decay)
            out.append((optimiser.steps, row.loss))
    return out


def validate(samples: DataFrame, steps: DataFrame, predict, shape: tuple[int, int, int], seed: int = 0, most: int = SHOWN) -> tuple[float, DataFrame]:
    """Mean |made - target| over the whole reverse chain of the first samples (sample, c, y, x, v, cond), of a shape, and their pixels: sample (from 0), c, i, j, lr, made, hr."""
    first = [r[0] for r in samples.select("sample").distinct().orderBy("sample").limit(most).collect()]
    own = samples.where(F.col("sample").isin(first))
    rows = own.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("c", "y", "x", "cond", "v"))).alias("cells"))  # a patch a row
    made = sample_chain(rows.select("sample", F.col("cells.cond").alias("cond")), steps, predict, shape, seed)
    both = rows.join(made, "sample").select("sample", F.posexplode(F.arrays_zip("cells", "made")).alias("k", "z"))
    number = F.array_position(F.lit(first), F.col("sample")).cast("int") - 1 if first else F.lit(0)
    images = both.select(number.alias("sample"), F.col("z.cells.c").alias("c"), F.col("z.cells.y").alias("i"), F.col("z.cells.x").alias("j"), F.col("z.cells.cond").alias("lr"), F.col("z.made").alias("made"), F.col("z.cells.v").alias("hr"))
    return mean_absolute_error(images, "made", "hr").first().loss, images


def train(spark: SparkSession, config: Config, resume: str | None = None) -> dict[str, float]:
    """Index, samples, epochs, validation, test. Returns the last metrics.

    Below <log_dir>/<name>: checkpoints/epoch=<n>, a table `metrics` (epoch, step, name, value, rate) and
    a grid of images of each epoch. `resume` goes on from the newest checkpoint there ("") or in the
    folder it names; None begins anew, and refuses a folder that has checkpoints. A split without a mask is left out.
    """
    from gridloom.plans.commands import index_table

    root = f"{config.log_dir.rstrip('/')}/{config.name}"
    store = Snapshots(spark, f"{resume or root}/checkpoints", "epoch")
    done = store.committed()
    if done and resume is None:
        raise ValueError(f"{root} has checkpoints; resume them or choose another name")
    if resume is not None and not done:
        raise ValueError(f"no checkpoint below {resume or root}")
    optimiser = Optimiser.of(store.read(done[-1])) if done else Optimiser()
    store = Snapshots(spark, f"{root}/checkpoints", "epoch")
    table, rasters, pixels = index_table(spark, config.dataset)
    splits = {s: stored_samples(spark, f"{root}/samples-{s}", table.where(F.col("split") == s), rasters, pixels, config) for s, path in config.dataset.masks if path}
    if "train" not in splits:
        raise ValueError("no mask of the split train")
    steps, rate, last = schedule(spark, config.trainer.steps), config.trainer.learning_rate, {}

    def note(rows: list[tuple[int, int, str, float]]) -> None:
        spark.createDataFrame([(*r, rate) for r in rows], "epoch int, step int, name string, value double, rate double").coalesce(1).write.mode("append").parquet(f"{root}/metrics")
        last.update({name: value for _, _, name, value in rows})

    def checked(split: str, epoch: int) -> None:
        if split in splits and not splits[split].isEmpty():
            p = config.dataset.patch_size
            loss, images = validate(splits[split], steps, predictor(optimiser.weights), (len(config.dataset.bands), p, p), config.trainer.seed)
            note([(epoch, optimiser.steps, f"{split}_l1", float(loss))])
            size, grid = p + 2, dataset.comparison_grid(images, p)
            os.makedirs(root, exist_ok=True)
            write_png(grid.withColumn("v", F.col("v") * 255), f"{root}/{split}-{epoch}.png", SHOWN * size + 2, 3 * size + 2)

    for epoch in range(done[-1] + 1 if done else 0, config.trainer.max_epochs):
        losses = fit_epoch(splits["train"], steps, optimiser, epoch, config)
        store.write(optimiser.table(spark), epoch)
        note([(epoch, k, "train_l1", float(v)) for k, v in losses] or [(epoch, 0, "train_l1", float("nan"))])
        checked("val", epoch)
    checked("test", config.trainer.max_epochs - 1)
    return last
