"""Whole runs from files to files, and a thin command line: index, train, infer, degrade, project, demo."""

from __future__ import annotations

import argparse
import os
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.columns import byte_clip, shifted, window_of
from gridloom.functions.geodesy import moved_rings
from gridloom.operators.resample import decimate, degrade, low_frequency_projection, synthetic_scene
from gridloom.operators.spatial import mask_bounds
from gridloom.operators.unet import load_weights
from gridloom.plans.config import DatasetConfig, InferConfig, load, norm_range
from gridloom.plans.dataset import split_counts, stored_patch_index
from gridloom.plans.denoise import as_bytes, denoise, size_of
from gridloom.sources.tiff import block_pixels, list_rasters, read_blocks, read_headers, read_window, to_tiles, write_png, write_tiff
from gridloom.sources.store import fingerprint
from gridloom.sources.vector import read_polygons, reference_of, write_boxes

#: Fixed values of the demonstration scene: side, geotransform and mask boxes in pixels.
DEMO_SIDE, DEMO_TRANSFORM = 2048, [500000.0, 1.0, 0.0, 4000000.0, 0.0, -1.0]
DEMO_BOXES = {"train": (0, 0, 1024, 2048), "val": (1024, 0, 1536, 512), "test": (1536, 512, 1792, 768)}


def scene(spark: SparkSession, path: str, bands: list[int] | None = None, window: tuple[int, int, int, int] | None = None) -> tuple[DataFrame, dict]:
    """Pixels (c, y, x, v) and header of one raster file, or of a window (first row, first column, rows, columns) of it: only its tiles are read."""
    header = read_headers(spark, path).first().asDict()
    return read_window(spark, path, bands, *(window or ())).select("c", "y", "x", "v"), header


def save(pixels: DataFrame, out: str, header: dict, gt: list[float] | None = None) -> None:
    """8-bit pixels as a tiled, compressed raster with the header's georeference."""
    h, w = size_of(pixels)
    bands = pixels.select("c").distinct().count()
    nodata = (header.get("nodata") or [None])[0]
    write_tiff(to_tiles(pixels), out, h, w, bands, gt or header["gt"], header.get("wkt") or "", nodata=nodata)


def layer(spark: SparkSession, path: str, wkt: str | None) -> DataFrame:
    """The polygons of a layer in the reference system of a raster. A layer, or a raster, that names none is taken to have the other's."""
    rows, own = read_polygons(spark, path), reference_of(spark, path)
    return moved_rings(rows, own, wkt) if own and wkt and own != wkt else rows


def state_folder(spark: SparkSession, path: str, out: str) -> str:
    """Where the state of a run lies: below the folder that executors share, or beside the output where there is none. The same run finds it again."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared.rstrip('/')}/infer-{fingerprint({'scene': path, 'out': out})}" if shared else f"{os.path.abspath(out)}.state"


def export(result: DataFrame, out: str, header: dict) -> None:
    """A state as an 8-bit raster, with a preview beside it."""
    result = as_bytes(result)
    save(result, out, header)
    h, w = size_of(result)
    small = decimate(result, (h, w))
    s = max(1.0, max(h, w) / 2048)
    write_png(small, os.path.splitext(out)[0] + ".png", max(1, round(h / s)), max(1, round(w / s)))


def infer(spark: SparkSession, path: str, out: str, config: InferConfig, checkpoint: str | None = None) -> str:
    """Denoises a scene and writes it, with a preview beside it; an interrupted run goes on from its state. Returns the raster's path.

    `out` is a raster or a folder. In a folder, the state of every saved step is exported too, as
    step_<t>.tif, and the result is step_0.tif. `checkpoint` is an .npz file of weights, and needs config.predictor "network".
    """
    pixels, header = scene(spark, path, list(config.bands))
    folder = not out.lower().endswith((".tif", ".tiff"))
    if folder:
        os.makedirs(out, exist_ok=True)
    saved = (lambda state, t: export(state, os.path.join(out, f"step_{t}.tif"), header)) if folder else None
    result = denoise(pixels, config, state_folder(spark, path, out), weights=load_weights(checkpoint) if checkpoint else None, saved=saved)
    if not folder:
        export(result, out, header)
    return os.path.join(out, "step_0.tif") if folder else out


def infer_config(settings: str | None, **options) -> InferConfig:
    """Options of a run: bands and patch size come from the data set of a settings file, where one is given, and anything in options that isn't None goes first."""
    own = load(settings).dataset if settings else None
    base = replace(InferConfig(), patch_size=own.patch_size, bands=own.bands) if own else InferConfig()
    return replace(base, **{k: v for k, v in options.items() if v is not None})


def degrade_scene(spark: SparkSession, path: str, out: str, scale: int = 5, mask: str | None = None) -> tuple[str, str]:
    """Two rasters: the scene, cropped to the masks' bounds if there are any, and the same degraded. Returns their paths."""
    header = read_headers(spark, path).first().asDict()
    gt = F.array(*[F.lit(x) for x in header["gt"]])
    x0, y0, w, h = 0, 0, header["width"], header["height"]
    if mask:
        raster = spark.createDataFrame([(path, w, h, header["gt"])], "path string, width int, height int, gt array<double>")
        bounds = mask_bounds(layer(spark, mask, header["wkt"]).drop("path"), raster)
        window = bounds.select(*[c.alias(k) for k, c in window_of((F.col("bx0"), F.col("by0"), F.col("bx1"), F.col("by1")), gt, F.lit(w), F.lit(h)).items()]).first()
        if window is None:
            raise ValueError("no mask meets the raster")
        x0, y0, w, h = window.x_off, window.y_off, window.x_size, window.y_size
    cut = scene(spark, path, window=(y0, x0, h, w))[0].withColumns({"y": F.col("y") - y0, "x": F.col("x") - x0})
    moved = spark.range(1).select(shifted(gt, F.lit(x0), F.lit(y0)).alias("gt")).first()["gt"]
    base = os.path.splitext(os.path.basename(path))[0]
    names = tuple(os.path.join(out, f"{base}_{kind}.tif") for kind in ("hr", "sr"))
    save(cut, names[0], header, moved)
    save(degrade(cut, (h, w), (max(1, h // scale), max(1, w // scale)), byte=header["dtype"] == "uint8"), names[1], header, moved)
    return names


def project(spark: SparkSession, sr: str, obs: str, out: str, scale: int = 5) -> None:
    """Writes sr with the low frequencies of obs, on their common extent, first three bands."""
    (a, header), (b, other) = scene(spark, sr, [1, 2, 3]), scene(spark, obs, [1, 2, 3])
    size = min(header["height"], other["height"]), min(header["width"], other["width"])
    result = low_frequency_projection(a, b, size, scale)
    save(result.withColumn("v", byte_clip(F.col("v"))), out, header)


def demo(spark: SparkSession, out: str, side: int = DEMO_SIDE, octaves: int = 7) -> None:
    """The synthetic scene and one mask layer for each split."""
    os.makedirs(out, exist_ok=True)
    save(synthetic_scene(spark, side, octaves), os.path.join(out, "scene.tif"), {"gt": DEMO_TRANSFORM, "wkt": "WGS 84 / UTM zone 10N"})
    gx, _, _, gy, _, _ = DEMO_TRANSFORM
    for split, (x0, y0, x1, y1) in DEMO_BOXES.items():
        write_boxes(os.path.join(out, f"{split}.shp"), [(gx + x0, gy - y1, gx + x1, gy - y0)])


def index_table(spark: SparkSession, config: DatasetConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The patch index of a data set, its rasters and their pixels; the index is stored under the data folder. A split without a mask is left out."""
    list_rasters(spark, config.root_dir)
    rasters = read_headers(spark, config.root_dir)
    wkts = sorted(r[0] for r in rasters.select("wkt").where("wkt <> ''").distinct().limit(2).collect())
    if len(wkts) > 1:
        raise ValueError("the rasters have different reference systems")
    masks = None
    for split, path in config.masks:
        if path:
            own = layer(spark, path, wkts[0] if wkts else None).drop("path").withColumn("split", F.lit(split))
            masks = own if masks is None else masks.union(own)
    if masks is None:
        raise ValueError("no mask is given")
    pixels = block_pixels(read_blocks(spark, config.root_dir))
    return stored_patch_index(spark, f"{config.root_dir}/patch_index", rasters, masks, pixels, config), rasters, pixels


def index(spark: SparkSession, settings: str) -> DataFrame:
    """Patch counts of each split."""
    return split_counts(index_table(spark, load(settings).dataset)[0])


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="gridloom")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("index")
    p.add_argument("-c", "--config", required=True)
    p = sub.add_parser("infer")
    p.add_argument("--sr-path", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--config")
    p.add_argument("--checkpoint")
    p.add_argument("--patch-size", type=int)
    p.add_argument("--stride", type=int)
    p.add_argument("--batch-size", type=int)
    p.add_argument("--steps", type=int)
    p.add_argument("--save-freq", type=int)
    p.add_argument("--fusion-mode", choices=("sdvc", "avg"))
    p.add_argument("--seed", type=int)
    p.add_argument("--norm-range")
    p = sub.add_parser("train")
    p.add_argument("-c", "--config", required=True)
    p.add_argument("--resume", nargs="?", const="")
    p = sub.add_parser("degrade")
    p.add_argument("input_path")
    p.add_argument("output_path")
    p.add_argument("--scale", type=int, default=5)
    p.add_argument("--mask")
    p = sub.add_parser("project")
    p.add_argument("--sr", required=True)
    p.add_argument("--obs", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--scale", type=int, default=5)
    p = sub.add_parser("demo")
    p.add_argument("out")
    p.add_argument("--side", type=int, default=DEMO_SIDE)
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("gridloom").getOrCreate()
    if a.command == "index":
        index(spark, a.config).show()
    elif a.command == "infer":
        options = {"patch_size": a.patch_size, "stride": a.stride, "batch_size": a.batch_size, "steps": a.steps, "save_every": a.save_freq, "fusion": a.fusion_mode, "seed": a.seed, "norm_range": norm_range(a.norm_range), "predictor": "network" if a.checkpoint else None}
        infer(spark, a.sr_path, a.output, infer_config(a.config, **options), a.checkpoint)
    elif a.command == "train":
        from gridloom.plans.training import train

        print(train(spark, load(a.config), a.resume))
    elif a.command == "degrade":
        degrade_scene(spark, a.input_path, a.output_path, a.scale, a.mask)
    elif a.command == "project":
        project(spark, a.sr, a.obs, a.out, a.scale)
    else:
        demo(spark, a.out, a.side)


if __name__ == "__main__":
    main()
