"""From a catalogue of rasters and masks to a patch index, and from the index to training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.columns import is_nodata, signed_unit
from gridloom.operators import spatial
from gridloom.operators.resample import area_weights, cubic_weights, overview
from gridloom.plans.config import DatasetConfig
from gridloom.sources.store import Snapshots, cached

#: The levels of a pyramid.
LEVELS = (8, 16, 32)


def nodata_of(rasters: DataFrame, band: int, fallback: float | None = None) -> DataFrame:
    """rasters with nodata_value: the given value before the band's own, null without either."""
    return rasters.withColumn("nodata_value", F.coalesce(F.lit(fallback).cast("double"), F.get(F.col("nodata"), F.lit(band - 1))))


def cache_key(rasters: DataFrame, mask: str, config: DatasetConfig) -> DataFrame:
    """The readable key of a patch index: mask name, sizes, thresholds and a digest of the sorted paths."""
    digest = F.substring(F.md5(F.array_join(F.sort_array(F.collect_list("path")), "|").cast("binary")), 1, 8)  # one path a raster file
    c = config
    return rasters.agg(F.concat(F.lit(f"{mask}_ps{c.patch_size}_s{c.stride}_lr{c.lr_patch_size}_ot{c.overlap_threshold}_mn{c.max_nodata_ratio}_"), digest).alias("cache_key"))


def patch_index(rasters: DataFrame, masks: DataFrame, pixels: DataFrame, config: DatasetConfig) -> DataFrame:
    """Patches of every split: inside the masks by area first, then not beyond the NoData share of the first band.

    Headers decide before any pixel is read; only blocks under surviving patches take part in the last step.
    """
    boxes = spatial.settled(spatial.disjoint_boxes(masks))
    some = spatial.patches(rasters, boxes, config.patch_size, config.stride, config.overlap_threshold)
    values = nodata_of(rasters, config.bands[0], config.nodata_value).select("path", "nodata_value")
    band = pixels.where(F.col("c") == config.bands[0]).select("path", "y", "x", "v").join(values, "path")
    flags = band.select("path", "y", "x", F.when(is_nodata(F.col("v"), F.col("nodata_value")), 1.0).otherwise(0.0).alias("v"))
    rated = spatial.nodata_share(some, flags, F.lit(1.0))
    return rated.where(F.col("nodata_ratio") <= config.max_nodata_ratio)


def stored_patch_index(spark: SparkSession, root: str, rasters: DataFrame, masks: DataFrame, pixels: DataFrame, config: DatasetConfig) -> DataFrame:
    """The index from its table, made when there is none for these rasters, masks and settings; all of them count."""
    content = lambda t: t.agg(F.sum(F.xxhash64(*t.columns).cast("decimal(38,0)")), F.count("*")).first()
    about = {"config": config, "rasters": content(rasters), "masks": content(masks)}
    return cached(spark, root, about, lambda: patch_index(rasters, masks, pixels, config))


def split_counts(index: DataFrame) -> DataFrame:
    return index.groupBy("split").agg(F.count("*").alias("patches"))


def patch_pixels(index: DataFrame, rasters: DataFrame, pixels: DataFrame, config: DatasetConfig, block: int = 256) -> DataFrame:
    """path, x_offset, y_offset, c, i, j, v: pixels of each patch in the chosen bands, NoData as 0.

    Patches are dealt to the blocks that they touch and meet pixels by equality. Every patch
    appears once, whatever the splits that hold it.
    """
    p, keys = config.patch_size, ["path", "x_offset", "y_offset"]
    reach = lambda c: F.explode(F.sequence(F.expr(f"{c} div {block}"), F.expr(f"({c} + {p - 1}) div {block}")))
    dealt = index.select(*keys).distinct().withColumn("by", reach("y_offset")).withColumn("bx", reach("x_offset"))
    blank = rasters.select("path", "nodata")
    own = pixels.where(F.col("c").isin(*config.bands)).select("path", "c", "y", "x", "v", F.expr(f"cast(y as bigint) div {block}").alias("by"), F.expr(f"cast(x as bigint) div {block}").alias("bx"))
    met = own.join(dealt, ["path", "by", "bx"]).join(blank, "path")
    i, j = F.col("y") - F.col("y_offset"), F.col("x") - F.col("x_offset")
    value = F.coalesce(F.lit(config.nodata_value).cast("double"), F.get(F.col("nodata"), F.col("c") - 1))
    inside = met.where(i.between(0, p - 1) & j.between(0, p - 1))
    return inside.select(*keys, "c", i.alias("i"), j.alias("j"), F.when(is_nodata(F.col("v"), value), 0.0).otherwise(F.col("v")).alias("v"))


def samples(patch: DataFrame, config: DatasetConfig, byte: bool = True) -> DataFrame:
    """path, x_offset, y_offset, c, i, j, hr, lr: pairs in -1..1, lr being hr degraded to lr_patch_size and back.

    The four passes are sums over weight tables of an axis; with `byte` values are rounded after each resize.
    """
    spark, p, q, keys = patch.sparkSession, config.patch_size, config.lr_patch_size, ["path", "x_offset", "y_offset", "c"]
    held = lambda v: F.rint(F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0))) if byte else v

    def one(rows: DataFrame, weights: DataFrame, axis: str, after) -> DataFrame:
        other = "i" if axis == "j" else "j"
        w = F.broadcast(weights.withColumnRenamed("k", axis))  # rows: a few times the patch size
        return rows.join(w, axis).groupBy(*keys, other, "d").agg(after(F.sum(F.col("v") * F.col("wt"))).alias("v")).withColumnRenamed("d", axis)

    down, up, same = area_weights(spark, p, q), cubic_weights(spark, q, p), lambda v: v
    low = one(one(patch, down, "j", same), down, "i", held)
    back = one(one(low, up, "j", same), up, "i", held)
    return patch.withColumnRenamed("v", "hr").join(back.withColumnRenamed("v", "lr"), [*keys, "i", "j"]).select(*keys, "i", "j", signed_unit(F.col("hr")).alias("hr"), signed_unit(F.col("lr")).alias("lr"))


def sample_rows(pairs: DataFrame, config: DatasetConfig) -> DataFrame:
    """path, x_offset, y_offset, hr, lr: arrays in order of band, row and column, of the size of a patch."""
    cells = F.array_sort(F.collect_list(F.struct("c", "i", "j", F.col("hr").cast("float").alias("hr"), F.col("lr").cast("float").alias("lr"))))
    rows = pairs.groupBy("path", "x_offset", "y_offset").agg(cells.alias("cells"))
    return rows.select("path", "x_offset", "y_offset", F.col("cells.hr").alias("hr"), F.col("cells.lr").alias("lr"))


def shuffled(index: DataFrame, epoch: int, seed: int = 0) -> DataFrame:
    """The index in an order that depends on its keys, the seed and the epoch."""
    return index.orderBy(F.md5(F.concat_ws("|", "path", "x_offset", "y_offset", F.lit(seed), F.lit(epoch)).cast("binary")), "path", "x_offset", "y_offset")


def stored_pyramid(spark: SparkSession, root: str, pixels: DataFrame, levels: tuple[int, ...] = LEVELS, byte: bool = False) -> DataFrame:
    """level, c, oy, ox, v: overviews of a scene below root, each made once; the scene is not changed.

    A level that is a multiple of another could be made from it, but bytes are rounded once, from pixels.
    """
    store = Snapshots(spark, root, "level")
    out = None
    for level in levels:
        own = store.read(level) if level in store.committed() else store.write(overview(pixels, level, byte), level)
        own = own.select(F.lit(level).alias("level"), "c", "oy", "ox", "v")
        out = own if out is None else out.union(own)
    return out


def latest(files: DataFrame) -> DataFrame:
    """The most recent of files (path, modificationTime); of equals the last by path."""
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def comparison_grid(images: DataFrame, size: int, padding: int = 2, most: int = 8) -> DataFrame:
    """Pixels (sample, c, i, j, lr, made, hr in -1..1) of the first samples, laid side by side in 0..1: c, y, x, v."""
    v = F.posexplode(F.array("lr", "made", "hr"))
    rows = images.where((F.col("sample") < most) & (F.col("c") <= 3)).select("sample", "c", "i", "j", v.alias("column", "u"))
    step = size + padding
    unit = (F.least(F.greatest(F.col("u"), F.lit(-1.0)), F.lit(1.0)) + 1) / 2
    return rows.select("c", (F.col("sample") * step + padding + F.col("i")).cast("int").alias("y"), (F.col("column") * step + padding + F.col("j")).cast("int").alias("x"), unit.alias("v"))
