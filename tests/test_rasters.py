import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import columns as C
from gridloom.operators import diffusion, fusion, resample, spatial, tiling, unet
from gridloom.plans import commands, dataset, denoise
from gridloom.plans.config import Config, DatasetConfig, InferConfig, config_of, norm_range
from gridloom.sources import tiff, vector
from gridloom.sources.store import Snapshots
from gridloom.streaming import accumulate


def pixels(spark, h, w, f=lambda c, y, x: (c * 31 + y * 7 + x * 3) % 50, bands=(1,)):
    return spark.createDataFrame([(c, y, x, float(f(c, y, x))) for c in bands for y in range(h) for x in range(w)], "c int, y int, x int, v double")


def image(rows, bands, h, w):
    out = np.full((bands, h, w), np.nan)
    for r in rows.collect():
        out[r.c - 1, r.y, r.x] = r.v
    return out


@pytest.mark.parametrize(("h", "w", "p", "s", "n"), [(256, 256, 128, 96, 9), (250, 300, 128, 96, 9), (4329, 4818, 512, 384, 143), (128, 128, 128, 96, 1), (40, 40, 8, 12, 16)])
def test_known_tile_counts(spark, h, w, p, s, n):
    rows = tiling.views(spark, h, w, p, s).orderBy("tile_id").collect()
    assert [r.tile_id for r in rows] == list(range(n))
    if (h, w) == (250, 300):
        assert {r.h0 for r in rows} == {0, 96, 122} and {r.w0 for r in rows} == {0, 96, 172}


def test_a_small_scene_is_refused(spark):
    with pytest.raises(ValueError):
        tiling.views(spark, 100, 300, 128, 96)


def test_covering_starts_equal_brute_force(spark):
    for length, size, stride in [(45, 16, 12), (40, 8, 12), (16, 16, 5), (33, 7, 3), (50, 10, 10), (51, 10, 10)]:
        starts = sorted({*range(0, length - size + 1, stride), length - size})
        got = spark.range(length).select("id", C.covering_starts(F.col("id"), length, size, stride).alias("s")).collect()
        for r in got:
            assert sorted(r.s) == [a for a in starts if a <= r.id < a + size], (length, size, stride, r.id)


def test_patch_counts_of_the_demonstration(spark):
    gt = commands.DEMO_TRANSFORM
    raster = spark.createDataFrame([("scene", 2048, 2048, gt, "", None), ("small", 100, 100, gt, "", None)], "path string, width int, height int, gt array<double>, wkt string, nodata array<double>")
    boxes = [(k, gt[0] + a, gt[3] - d, gt[0] + c, gt[3] - b) for k, (a, b, c, d) in commands.DEMO_BOXES.items()]
    masks = spark.createDataFrame(boxes, "split string, x0 double, y0 double, x1 double, y1 double")
    got = {r.split: r.patches for r in dataset.split_counts(spatial.patches(raster, masks, 128, 128, 0.9)).collect()}
    assert got["train"] == 128 and got["val"] == 16


def test_masks_that_overlap_count_once_and_either_join_agrees(spark, monkeypatch):
    masks = spark.createDataFrame([("a", 0.0, 0.0, 10.0, 10.0), ("a", 5.0, 5.0, 15.0, 15.0), ("a", 10.0, 0.0, 12.0, 5.0), ("b", 0.0, 0.0, 1.0, 1.0)], "split string, x0 double, y0 double, x1 double, y1 double")
    boxes = spatial.disjoint_boxes(masks)
    area = {r.split: r.a for r in boxes.groupBy("split").agg(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("a")).collect()}
    assert area == {"a": 185.0, "b": 1.0}
    left = spark.createDataFrame([(i, float(i), float(i), i + 3.0, i + 2.0) for i in range(-4, 18)], "k int, minx double, miny double, maxx double, maxy double")
    near = sorted(map(tuple, spatial.meets(left, masks).select("k", "split", "x0").collect()))
    monkeypatch.setattr(spatial, "MASK_ROWS", 0)
    assert sorted(map(tuple, spatial.meets(left, masks, 4.0).select("k", "split", "x0").collect())) == near
    with pytest.raises(ValueError):
        spatial.meets(left, masks)


def test_the_patch_index_is_the_same_beyond_the_broadcast(spark, monkeypatch):
    gt = [0.0, 1.0, 0.125, 500.0, 0.25, -1.0]
    rasters = spark.createDataFrame([(f"r{i}", 120 + 9 * i, 90 + 11 * i, [40.0 * i, *gt[1:3], 500.0 - 30 * i, *gt[4:]], "", [0.0]) for i in range(4)], "path string, width int, height int, gt array<double>, wkt string, nodata array<double>")
    masks = spark.createDataFrame([(s, 25.0 * i, 300.0 + 17 * i, 25.0 * i + 70, 300.0 + 17 * i + 90) for i in range(9) for s in ("train", "val")][:-3], "split string, x0 double, y0 double, x1 double, y1 double")
    some = spark.createDataFrame([(f"r{i}", 1, y, x, float((x * y + i) % 3)) for i in range(4) for y in range(0, 130, 3) for x in range(0, 150, 3)], "path string, c int, y int, x int, v double")
    config = DatasetConfig(patch_size=32, stride=16, lr_patch_size=8, bands=(1,), overlap_threshold=0.3, max_nodata_ratio=0.6)

    def everything():
        boxes = spatial.disjoint_boxes(masks)
        rows = [dataset.patch_index(rasters, masks, some, config).select("path", "split", "x_offset", "y_offset", F.round("overlap_ratio", 9), "nodata_ratio"), spatial.valid_area(rasters, boxes).withColumn("area", F.round("area", 6)), spatial.mask_bounds(masks, rasters)]
        return [sorted(map(tuple, r.collect())) for r in rows]

    near = everything()
    assert all(near)
    monkeypatch.setattr(spatial, "MASK_ROWS", 0)
    assert everything() == near


def test_rings_are_clipped():
    ell = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)]
    assert spatial.ring_area(ell) == 7 and spatial.ring_area(spatial.clip_ring(ell, (0, 0, 2, 2))) == 3
    assert spatial.clip_ring(ell, (8, 8, 9, 9)) == [] and spatial.ring_area(spatial.clip_ring(ell, (-1, -1, 9, 9))) == 7


def test_windows_of_bounds(spark):
    gt = F.array(*map(F.lit, (100.0, 2.0, 0.0, 500.0, 0.0, -2.0)))
    row = spark.range(1).select(*[c.alias(k) for k, c in C.window_of((F.lit(103.0), F.lit(480.0), F.lit(131.0), F.lit(495.0)), gt, F.lit(12), F.lit(50)).items()]).first()
    assert tuple(row) == (1, 2, 11, 8)


@pytest.mark.parametrize(("n", "m", "cells"), [(50, 10, 50), (512, 102, 612), (128, 26, 152)])
def test_area_weights(spark, n, m, cells):
    rows = resample.area_weights(spark, n, m).collect()
    assert len(rows) == cells
    total = np.bincount([r.d for r in rows], [r.wt for r in rows])
    assert np.allclose(total, 1)


def test_resampling_keeps_constants_and_block_means(spark):
    flat = pixels(spark, 20, 30, lambda c, y, x: 7.0)
    assert np.allclose(image(resample.degrade(flat, (20, 30), (6, 7)), 1, 20, 30), 7)
    assert np.allclose(image(resample.low_frequency_projection(flat, flat, (20, 30), 5), 1, 20, 30), 7)
    some = pixels(spark, 20, 30)
    got = image(resample.down_area(some, (20, 30), (4, 6)), 1, 4, 6)
    assert np.allclose(got[0], image(some, 1, 20, 30)[0].reshape(4, 5, 6, 5).mean(axis=(1, 3)))
    total = np.zeros(40)
    for r in resample.cubic_weights(spark, 17, 40).collect():
        total[r.d] += r.wt
    assert np.allclose(total, 1)


def test_large_weight_tables_and_images_are_not_broadcast(spark, monkeypatch):
    sr, obs = pixels(spark, 24, 16), pixels(spark, 24, 16, lambda c, y, x: (y * 5 + x * 11) % 60)
    want = image(resample.low_frequency_projection(sr, obs, (24, 16), 4), 1, 24, 16)
    monkeypatch.setattr(resample, "BROADCAST_ROWS", 10)
    rows = resample.low_frequency_projection(sr, obs, (24, 16), 4)
    assert np.allclose(image(rows, 1, 24, 16), want)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_bytes_are_rounded_half_to_even(spark):
    row = spark.range(1).select(C.byte_of_signed(F.lit(0.0)).alias("a"), C.byte_of_signed(F.lit(-9.0)).alias("b"), C.byte_clip(F.lit(126.5)).alias("c"), C.byte_clip(F.lit(300.0)).alias("d"), C.signed_unit(F.lit(3.0), 3.0, 3.0).alias("e")).first()
    assert tuple(row) == (128, 0, 126, 255, 0.0)


def test_nodata_is_close_and_never_nan(spark):
    rows = spark.createDataFrame([(100.0005, 100.0), (100.01, 100.0), (float("nan"), 1.0), (float("nan"), float("nan")), (1.0, None), (None, 1.0)], "v double, nd double").select(C.is_nodata(F.col("v"), F.col("nd")).alias("x")).collect()
    assert [r.x for r in rows] == [True, False, False, False, False, False]


def test_fusion_keeps_variance_and_degrades_to_the_average(spark):
    grid = tiling.covered(pixels(spark, 45, 45), 45, 45, 16, 12)
    maps = fusion.geometry_maps(grid).collect()
    assert len(maps) == 45 * 45
    shares = grid.join(fusion.geometry_maps(grid), ["y", "x"]).groupBy("y", "x").agg(F.sum(F.col("w") / F.col("wsum")).alias("a"), F.sum(F.col("w") * F.col("w") / F.col("w2sum")).alias("b")).agg(F.max(F.abs(F.col("a") - 1)), F.max(F.abs(F.col("b") - 1))).first()
    assert max(shares) < 1e-12
    still = grid.withColumns({"mu": F.col("v"), "n": F.lit(0.0)})
    assert np.allclose(image(fusion.fuse_average(still), 1, 45, 45), image(fusion.fuse_variance_preserving(still), 1, 45, 45))
    noisy = grid.withColumns({"mu": F.col("v"), "n": C.gaussian(F.col("y"), F.col("x"), F.col("h0") * 99 + F.col("w0"))})
    assert np.allclose(image(fusion.fuse_with_maps(noisy, fusion.geometry_maps(grid)), 1, 45, 45), image(fusion.fuse_variance_preserving(noisy), 1, 45, 45))


def test_maps_of_the_geometry_are_not_broadcast(spark):
    parts = tiling.covered(pixels(spark, 20, 20), 20, 20, 8, 6).select("c", "y", "x", "w", F.col("v").alias("mu"), (F.col("v") / 10).alias("n"))
    joined = fusion.fuse_with_maps(parts, fusion.geometry_maps(parts))
    assert np.allclose(image(joined, 1, 20, 20), image(fusion.fuse_variance_preserving(parts), 1, 20, 20))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_keyed_noise_is_normal_and_independent_of_partitions(spark):
    rows = spark.range(20000).select(F.col("id"), C.gaussian(F.col("id") % 100, F.col("id"), F.lit(3)).alias("z"))
    z = np.array([r.z for r in rows.orderBy("id").collect()])
    again = np.array([r.z for r in rows.repartition(7).orderBy("id").collect()])
    assert (z == again).all() and abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.03 and abs(np.corrcoef(z[1:], z[:-1])[0, 1]) < 0.03


def test_noise_of_tall_scenes_does_not_overflow(spark):
    def uniform(total):
        value = total % C.NOISE_MODULUS
        for add in C.NOISE_ROUNDS:
            value = (value * C.NOISE_STEP + add) % C.NOISE_MODULUS
            value = value * (value + add) % C.NOISE_MODULUS
        return (value + 0.5) / C.NOISE_MODULUS

    def normal(keys, seed):
        total = seed + 1 + sum(k * m for k, m in zip(keys, C.NOISE_KEYS, strict=True))
        return math.sqrt(-2 * math.log(uniform(total))) * math.cos(2 * math.pi * uniform(total + 1000003))

    places = [(39984, 0), (2**31 - 1, 2**31 - 1), (3, 4)]
    rows = spark.createDataFrame([(2, 40000, 9, *p) for p in places], "c int, y int, x int, h0 int, w0 int")
    got = rows.select(C.gaussian(F.col("c"), F.col("y"), F.col("x"), C.place_key(F.col("h0"), F.col("w0"), 65537), seed=5).alias("z")).collect()
    assert np.allclose([r.z for r in got], [normal((2, 40000, 9, h * 65537 + w), 5) for h, w in places])
    # the last row of a scene of 40,000 rows lies in one tile, (39984, 0)
    steps, config = diffusion.schedule(spark, 4), InferConfig(patch_size=16, stride=12, bands=(1,), seed=5, steps=4)
    line = steps.where("t = 2").first()
    state = spark.createDataFrame([(1, 39999, x, 0.1 * x, 0.5) for x in range(16)], "c int, y int, x int, v double, cond double")
    for r in denoise.joint_step(state, None, steps, 2, (40000, 16), config).collect():
        z = normal((1, 39999, r.x, 39984 * 65537), 5 + 7919 * 3)
        assert math.isclose(r.v, line.coef1 * 0.5 + line.coef2 * 0.1 * r.x + z * math.exp(line.post_logvar / 2), abs_tol=1e-9)


def test_schedules(spark):
    wide = {r.t: r for r in diffusion.schedule(spark).collect()}
    assert len(wide) == 2000 and math.isclose(wide[1999].acp, 4.386e-05, rel_tol=1e-3) and wide[0].post_var == 0 and math.isclose(wide[0].coef1, 1)
    single = {r.t: r for r in diffusion.schedule(spark, precision="f32").collect()}
    assert abs(single[0].coef1 - 0.98690) < 2e-4 and math.isclose(single[1999].acp, wide[1999].acp, rel_tol=1e-3)


def test_joint_chain_resumes_and_ends_at_the_condition(spark, tmp_path):
    scene = pixels(spark, 20, 24, bands=(1, 2))
    config = InferConfig(patch_size=12, stride=8, bands=(1, 2), steps=6, save_every=2, seed=3)
    whole = image(denoise.denoise(scene, config, str(tmp_path / "a")), 2, 20, 24)
    denoise.denoise(scene, config, str(tmp_path / "b"), stop_after=3)
    assert Snapshots(spark, str(tmp_path / "b")).committed() == [3]
    resumed = denoise.denoise(scene, config, str(tmp_path / "b"))
    assert np.allclose(image(resumed, 2, 20, 24), whole, atol=1e-12) and Snapshots(spark, str(tmp_path / "b")).committed() == [0]
    again = denoise.denoise(scene, config, str(tmp_path / "b"))
    assert np.allclose(image(again, 2, 20, 24), whole, atol=1e-12)
    cond = image(denoise.normalised(scene, (1, 2)), 2, 20, 24)
    assert np.allclose(whole, cond, atol=1e-9)
    with pytest.raises(ValueError):
        denoise.denoise(scene, InferConfig(patch_size=12, stride=6, bands=(1, 2), steps=6), str(tmp_path / "b"))


def test_array_layout_equals_pixel_layout(spark):
    scene = denoise.normalised(pixels(spark, 20, 24, bands=(1, 2)), (1, 2))
    state = diffusion.initial_state(scene, 1)
    steps = diffusion.schedule(spark, 50)
    row = steps.where("t = 0").first().asDict()
    oracle = lambda cond, x, level: (x - row["sqrt_acp"] * cond) / row["sqrt_1m"]
    tiles = denoise.tile_rows(state, scene, (20, 24), 12, 8)
    b = fusion.fuse_variance_preserving(denoise.tile_step(tiles, row, oracle, [1, 2], 12))
    a = denoise.joint_step(state, scene, steps, 0, (20, 24), InferConfig(patch_size=12, stride=8, bands=(1, 2)))
    assert np.allclose(image(a, 2, 20, 24), image(b, 2, 20, 24), atol=1e-9)


def test_single_patch_chain(spark):
    cond = [0.5, -0.25, 0.0, 0.75]
    steps = diffusion.schedule(spark, 30)
    table = {r.t: r for r in steps.collect()}
    by_level = {round(math.sqrt(r.acp), 12): r for r in table.values()}
    oracle = lambda cond, x, level: (x - by_level[round(level, 12)].sqrt_acp * cond) / by_level[round(level, 12)].sqrt_1m
    made = denoise.sample_chain(spark.createDataFrame([(1, cond), (2, cond)], "sample long, cond array<double>"), steps, oracle, (1, 2, 2)).collect()
    assert all(np.allclose(r.made, cond) for r in made)


def test_network_shapes_and_size():
    small = unet.Shape(bands=2, base=4, multipliers=(1, 2), groups=2)
    p = unet.initial_weights(small)
    rng = np.random.default_rng(0)
    out = unet.predict(p, small, rng.normal(size=(2, 8, 8)), rng.normal(size=(2, 8, 8)), 0.5)
    assert out.shape == (2, 8, 8) and np.isfinite(out).all()
    m = p["down0.c1.w"].reshape(4, -1)
    assert np.allclose(m @ m.T, np.eye(4))
    x, w, b = rng.normal(size=(3, 5, 6)), rng.normal(size=(2, 3, 3, 3)), rng.normal(size=2)
    padded, want = np.pad(x, ((0, 0), (1, 1), (1, 1))), np.zeros((2, 5, 6))
    for o in range(2):
        for i in range(5):
            for j in range(6):
                want[o, i, j] = (padded[:, i : i + 3, j : j + 3] * w[o]).sum() + b[o]
    assert np.allclose(unet.convolve(x, w, b), want)


@pytest.mark.parametrize("compression", ["lzw", "deflate", "none"])
def test_tiff_round_trip(spark, tmp_path, compression):
    scene = pixels(spark, 70, 90, lambda c, y, x: (c * y * x + x) % 256, (1, 2, 3))
    out, gt = str(tmp_path / "a.tif"), [500000.0, 2.0, 0.0, 4000000.0, 0.0, -2.0]
    tiff.write_tiff(tiff.to_tiles(scene, 32, compression), out, 70, 90, 3, gt, "local", 32, compression, nodata=0)
    header = tiff.read_headers(spark, out).first()
    assert (header.width, header.height, header.n_bands, header.dtype, header.gt, header.wkt, header.nodata) == (90, 70, 3, "uint8", gt, "local", [0.0] * 3)
    back = tiff.block_pixels(tiff.read_blocks(spark, out, 32), 32)
    assert np.array_equal(image(back, 3, 70, 90), image(scene, 3, 70, 90))
    assert [r.path.split("/")[-1] for r in tiff.list_rasters(spark, str(tmp_path)).collect()] == ["a.tif"]


def test_classic_strips_and_lzw():
    data = bytes(np.random.default_rng(0).integers(0, 5, 40_000).astype(np.uint8))
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data and tiff.lzw_decode(tiff.lzw_encode(b"")) == b""
    body = np.arange(12, dtype=">u2").reshape(3, 4)
    tags = [(256, 3, 4), (257, 3, 3), (258, 3, 16), (259, 3, 1), (273, 4, 8), (277, 3, 1), (278, 3, 3), (279, 4, 24)]
    raw = struct.pack(">2sHI", b"MM", 42, 32) + body.tobytes() + struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in tags) + b"\0" * 4
    assert np.array_equal(tiff.Tiff(raw).array()[0], body)


def test_windows_read_their_tiles_alone(spark, tmp_path, monkeypatch):
    scene = pixels(spark, 70, 90, lambda c, y, x: (c * y * x + x) % 256, (1, 2, 3))
    out = str(tmp_path / "a.tif")
    tiff.write_tiff(tiff.to_tiles(scene, 32), out, 70, 90, 3, [0.0, 1.0, 0.0, 0.0, 0.0, -1.0], "", 32)
    index = tiff.tile_index(spark, out)
    assert index.count() == 9 and index.agg(F.sum(F.col("h") * F.col("w"))).first()[0] == 70 * 90
    got = tiff.read_window(spark, out, [3, 1], 30, 60, 5, 8)
    want = scene.where("c <> 2 and y between 30 and 34 and x between 60 and 67")
    assert sorted(tuple(r)[1:] for r in got.collect()) == sorted(map(tuple, want.collect())) and want.count() == 80
    data, asked = open(out, "rb").read(), []
    real = tiff.Ranges.__call__
    monkeypatch.setattr(tiff.Ranges, "__call__", lambda self, at, size: asked.append(size) or real(self, at, size))
    with tiff.opened(out) as file:
        image_ = tiff.Tiff(file)
        assert image_.header()[:3] == (90, 70, 3) and sum(asked) < 1500
        one = image_.tiles()[4]
        assert np.array_equal(image_.decode(one), tiff.Tiff(data).array()[:, 32:64, 32:64])
    monkeypatch.setattr(tiff, "reads_ranges", lambda path: False)
    assert sorted(tuple(r)[1:] for r in tiff.read_window(spark, out, [3, 1], 30, 60, 5, 8).select("path", "c", "y", "x", "v").collect()) == sorted(map(tuple, want.collect()))
    assert tiff.read_headers(spark, out).first().width == 90


def test_nothing_to_read_is_an_error(spark, tmp_path):
    (tmp_path / "x.txt").write_text("")
    with pytest.raises(ValueError):
        tiff.list_rasters(spark, str(tmp_path))


def test_from_files_to_files(spark, tmp_path):
    commands.demo(spark, str(tmp_path / "in"), 64, 3)
    masks = vector.read_polygons(spark, str(tmp_path / "in" / "val.shp")).collect()
    assert len(masks) == 1 and (masks[0].x0, masks[0].y1) == (501024.0, 4000000.0) and len(masks[0].ring) == 4
    vector.write_boxes(str(tmp_path / "m.shp"), [(500010.0, 3999950.0, 500050.0, 3999990.0)])
    names = commands.degrade_scene(spark, str(tmp_path / "in" / "scene.tif"), str(tmp_path), 4, str(tmp_path / "m.shp"))
    header = tiff.read_headers(spark, names[1]).first()
    assert (header.width, header.height, header.gt[0], header.gt[3]) == (40, 40, 500010.0, 3999990.0)
    commands.project(spark, names[1], names[0], str(tmp_path / "p.tif"), 4)
    commands.infer(spark, names[0], str(tmp_path / "out.tif"), InferConfig(patch_size=16, stride=12, steps=2, save_every=1))
    a, b = (tiff.block_pixels(tiff.read_blocks(spark, n)) for n in (names[0], str(tmp_path / "out.tif")))
    assert tiff.read_headers(spark, str(tmp_path / "out.tif")).first().gt == header.gt and a.count() == b.count()
    assert (tmp_path / "out.png").read_bytes()[:4] == b"\x89PNG"
    settings = tmp_path / "c.yaml"
    settings.write_text(f"dataset:\n  root_dir: {tmp_path}/in\n  masks: {{train: {tmp_path}/m.shp, val: null}}\n  patch_size: 16\n  stride: 8\n  lr_patch_size: 4\n  bands: [1, 2]\n  overlap_threshold: 0.9\n  max_nodata_ratio: 0.1\n")
    first = commands.index(spark, str(settings)).collect()
    assert [(r.split, r.patches) for r in first] == [(r.split, r.patches) for r in commands.index(spark, str(settings)).collect()] and first[0].split == "train"
    from gridloom.plans.config import load

    config = load(str(settings)).dataset
    rasters, own = tiff.read_headers(spark, config.root_dir), tiff.block_pixels(tiff.read_blocks(spark, config.root_dir))
    index = dataset.patch_index(rasters, vector.read_polygons(spark, str(tmp_path / "m.shp")).drop("path").withColumn("split", F.lit("train")), own, config)
    patch = dataset.patch_pixels(index, rasters, own, config)
    rows = dataset.sample_rows(dataset.samples(patch, config), config).collect()
    assert len(rows) == index.count() and all(len(r.hr) == len(r.lr) == 2 * 16 * 16 and max(map(abs, r.lr)) <= 1 for r in rows)
    keys = ["path", "x_offset", "y_offset"]
    orders = [[tuple(r) for r in dataset.shuffled(index, epoch).select(*keys).collect()] for epoch in (1, 1, 2)]
    assert orders[0] == orders[1] != orders[2] and sorted(orders[0]) == sorted(orders[2]) and len(orders[0]) == len(rows) and orders[0] != sorted(orders[0])


def test_settings():
    c = config_of({"dataset": {"patch_size": 128, "bands": [1], "masks": {"train": "a", "test": None}}, "trainer": {"max_epochs": 2}})
    assert c.dataset.patch_size == 128 and c.trainer.max_epochs == 2 and dict(c.dataset.masks) == {"train": "a", "test": None} and isinstance(c, Config)
    for bad in ({"dataset": {"patch": 1}}, {"data": {}}, {"dataset": {"stride": 0}}):
        with pytest.raises(ValueError):
            config_of(bad)
    assert norm_range("0,255") == (0.0, 255.0) and norm_range(None) is None
    with pytest.raises(ValueError):
        DatasetConfig(overlap_threshold=2)


def test_contributions_stream(spark, tmp_path):
    grid = tiling.covered(pixels(spark, 20, 20), 20, 20, 8, 6).select(F.lit(0).alias("tile_id"), "c", "y", "x", "w", F.col("v").alias("mu"), F.lit(0.5).alias("n"))
    grid.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(accumulate.SCHEMA).parquet(str(tmp_path / "in"))
    query = accumulate.accumulate(stream, "totals", str(tmp_path / "state"))
    query.awaitTermination(60)
    for rule in ("sdvc", "avg"):
        got = image(accumulate.fused(spark.table("totals"), rule), 1, 20, 20)
        assert np.allclose(got, image(fusion.FUSIONS[rule](grid), 1, 20, 20))
