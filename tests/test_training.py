import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import geodesy
from gridloom.operators import diffusion, unet
from gridloom.plans import commands, denoise, training
from gridloom.plans.config import Config, DatasetConfig, InferConfig, LoaderConfig, TrainerConfig
from gridloom.sources import tiff, vector
from tests.test_rasters import image, pixels


@pytest.fixture(scope="module")
def settings(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("train")
    commands.demo(spark, str(folder / "in"), 64, 3)
    masks = {}
    for split, box in {"train": (500000.0, 3999936.0, 500040.0, 4000000.0), "val": (500040.0, 3999936.0, 500064.0, 4000000.0)}.items():
        masks[split] = str(folder / f"{split}.shp")
        vector.write_boxes(masks[split], [box])
    data = DatasetConfig(root_dir=f"{folder}/in", masks=tuple(sorted(masks.items())), patch_size=8, stride=8, lr_patch_size=2, bands=(1, 2), overlap_threshold=0.9)
    return Config("run", str(folder / "logs"), data, LoaderConfig(batch_size=4), TrainerConfig(max_epochs=4, accumulate_grad_batches=2, learning_rate=0.05, steps=20))


def test_training_learns_and_resumes(spark, settings):
    last = training.train(spark, settings)
    root = f"{settings.log_dir}/{settings.name}"
    metrics = spark.read.parquet(f"{root}/metrics").toPandas()
    loss = metrics[metrics.name == "train_l1"].groupby("epoch").value.mean()
    assert loss.iloc[-1] < loss.iloc[0] and np.isfinite(last["val_l1"]) and set(metrics.epoch) == {0, 1, 2, 3} and (metrics.rate == 0.05).all()
    assert open(f"{root}/val-3.png", "rb").read(4) == b"\x89PNG"
    whole = {r.name: r.weight for r in spark.read.parquet(f"{root}/checkpoints/epoch=3").collect()}
    part = dataclasses.replace(settings, name="part", trainer=dataclasses.replace(settings.trainer, max_epochs=2))
    training.train(spark, part)
    training.train(spark, dataclasses.replace(part, trainer=settings.trainer), "")
    again = {r.name: r.weight for r in spark.read.parquet(f"{settings.log_dir}/part/checkpoints/epoch=3").collect()}
    assert again.keys() == whole.keys() and all(abs(again[k] - whole[k]) < 1e-9 for k in whole)
    with pytest.raises(ValueError):
        training.train(spark, settings)
    with pytest.raises(ValueError):
        training.train(spark, dataclasses.replace(settings, name="none"), "")


def test_gradient_is_that_of_differences(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([tuple(map(float, r)) for r in rng.normal(size=(200, 4))], "cond double, noisy double, level double, noise double")
    w = rng.normal(size=6)
    row = training.gradient(rows, w).first()
    data = np.array([tuple(r) for r in rows.collect()])
    loss = lambda w: np.abs(training.predictor(w)(data[:, 0], data[:, 1], data[:, 2]) - data[:, 3]).mean()
    assert abs(row.loss - loss(w)) < 1e-9 and row.n == 200
    for k, name in enumerate(training.FEATURES):
        step = np.eye(6)[k] * 1e-7
        assert abs((loss(w + step) - loss(w - step)) / 2e-7 - row[name]) < 1e-4


def test_optimiser_steps_are_those_of_its_definition(spark):
    own, w, m, v, rng = training.Optimiser(np.ones(6)), np.ones(6), np.zeros(6), np.zeros(6), np.random.default_rng(1)
    for t in range(1, 6):
        g = rng.normal(size=6)
        own.step(g, 0.01, 0.1)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.01 * 0.1 * w - 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert np.allclose(own.weights, w)
    back = training.Optimiser.of(own.table(spark))
    assert np.array_equal(back.weights, own.weights) and np.array_equal(back.second, own.second) and back.steps == 5


def test_weights_round_trip_and_denoise(spark, tmp_path):
    kind = unet.Shape(bands=2, base=4, multipliers=(1, 2), groups=2)
    p = unet.initial_weights(kind)
    unet.save_weights(str(tmp_path / "w.npz"), p, kind)
    shape, back = unet.load_weights(str(tmp_path / "w.npz"))
    assert shape == kind and all(np.array_equal(p[k], back[k]) for k in p)
    np.savez(tmp_path / "bad.npz", __shape=np.array([2, 4, 2, 1, 2]))
    with pytest.raises(ValueError):
        unet.load_weights(str(tmp_path / "bad.npz"))
    scene = pixels(spark, 20, 24, bands=(1, 2))
    config = InferConfig(patch_size=12, stride=8, bands=(1, 2), steps=3, save_every=1, predictor="network")
    seen = []
    a = image(denoise.denoise(scene, config, str(tmp_path / "a"), weights=(shape, back), saved=lambda s, t: seen.append(t)), 2, 20, 24)
    denoise.denoise(scene, config, str(tmp_path / "b"), stop_after=1, weights=(shape, back))
    b = image(denoise.denoise(scene, config, str(tmp_path / "b"), weights=(shape, back)), 2, 20, 24)
    assert seen == [2, 1, 0] and np.isfinite(a).all() and np.allclose(a, b)
    with pytest.raises(ValueError):
        denoise.denoise(scene, config, str(tmp_path / "c"))
    steps = {r.t: r for r in diffusion.schedule(spark, 3).collect()}
    by_level = {round(r.acp**0.5, 12): r for r in steps.values()}
    oracle = lambda cond, x, level: (x - by_level[round(level, 12)].sqrt_acp * cond) / by_level[round(level, 12)].sqrt_1m
    made = image(denoise.denoise(scene, config, str(tmp_path / "d"), predict=oracle), 2, 20, 24)
    assert np.allclose(made, image(denoise.normalised(scene, (1, 2)), 2, 20, 24), atol=1e-9)
    rng = np.random.default_rng(0)
    x = unet.dropped(np.ones((4, 50, 50)), 0.25, rng)
    assert set(np.round(np.unique(x), 6)) == {0.0, round(1 / 0.75, 6)} and abs(x.mean() - 1) < 0.03


def test_infer_reads_settings_and_exports_steps(spark, tmp_path):
    commands.demo(spark, str(tmp_path / "in"), 32, 3)
    (tmp_path / "c.yaml").write_text(f"dataset:\n  root_dir: {tmp_path}/in\n  patch_size: 16\n  bands: [1, 2, 3]\n")
    config = commands.infer_config(str(tmp_path / "c.yaml"), stride=12, steps=4, save_every=2, seed=None)
    assert (config.patch_size, config.bands, config.stride, config.seed) == (16, (1, 2, 3), 12, 0)
    out = commands.infer(spark, str(tmp_path / "in" / "scene.tif"), str(tmp_path / "out"), config)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["step_0.png", "step_0.tif", "step_2.png", "step_2.tif"]
    a, b = (image(tiff.block_pixels(tiff.read_blocks(spark, p)), 3, 32, 32) for p in (out, str(tmp_path / "in" / "scene.tif")))
    lo, hi = b.min(), b.max()
    assert np.abs(a - np.round((b - lo) / (hi - lo) * 255)).max() <= 1


def test_points_move_between_systems(spark, tmp_path):
    one = spark.createDataFrame([(2.2945, 48.8582), (3.0, 0.0), (5.9, -33.5), (0.2, 71.0)], "lon double, lat double")
    x, y = geodesy.to_utm(F.col("lon"), F.col("lat"), 31)
    lon, lat = geodesy.from_utm(F.col("x"), F.col("y"), 31)
    rows = one.withColumn("x", x).withColumn("y", y).select("*", lon.alias("lon2"), lat.alias("lat2")).collect()
    assert all(abs(r.lon - r.lon2) < 1e-8 and abs(r.lat - r.lat2) < 1e-8 for r in rows)
    assert abs(rows[0].x - 448251.8) < 0.1 and abs(rows[0].y - 5411932.68) < 0.1 and abs(rows[1].x - 500000) < 1e-6 and abs(rows[1].y) < 1e-6
    assert geodesy.zone_of("WGS 84 / UTM zone 10N") == (10, False) and geodesy.zone_of("EPSG:32733") == (33, True) and geodesy.zone_of("EPSG:4326") == (0, False) and geodesy.zone_of("local") is None
    with pytest.raises(ValueError):
        geodesy.moved(F.col("lon"), F.col("lat"), "local", "EPSG:4326")
    utm, degrees = "WGS 84 / UTM zone 10N", "EPSG:4326"
    box = spark.createDataFrame([(500010.0, 3999950.0, 500050.0, 3999990.0)], "x0 double, y0 double, x1 double, y1 double")
    back = geodesy.moved_boxes(geodesy.moved_boxes(box, utm, degrees), degrees, utm).first()
    assert all(abs(a - b) < 0.01 for a, b in zip(back, box.first(), strict=True))
    r = geodesy.moved_boxes(box, utm, degrees).first()
    vector.write_boxes(str(tmp_path / "m.shp"), [tuple(r)], degrees)
    got = commands.layer(spark, str(tmp_path / "m.shp"), utm).first()
    assert vector.reference_of(spark, str(tmp_path / "m.shp")) == degrees and all(abs(a - b) < 0.01 for a, b in zip((got.x0, got.y0, got.x1, got.y1), box.first(), strict=True))
    assert commands.layer(spark, str(tmp_path / "m.shp"), degrees).first().x0 == r.x0
