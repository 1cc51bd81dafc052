"""Queries that go through files and stored tables: what is written is read again, and SQL gives what it should hold."""

from __future__ import annotations

import os
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import columns as C
from gridloom.functions import geodesy
from gridloom.operators import diffusion as D
from gridloom.operators import resample, spatial, tiling
from gridloom.plans import dataset, denoise, training
from gridloom.plans import queries as Q
from gridloom.plans.config import DatasetConfig, InferConfig, config_of, norm_range
from gridloom.plans.queries import query
from gridloom.sources import tiff, vector
from gridloom.sources.store import work_folder

SIZE, STEP, SMALL = 16, 12, 4


def folder(spark: SparkSession) -> str:
    """A new folder on the disk that is shared; raster files are written there by the driver."""
    at = f"{work_folder(spark).removeprefix('file://').removeprefix('file:')}/files-{uuid.uuid4().hex}"
    os.makedirs(at)
    return at


def stored_scene(spark: SparkSession, sf_dir: str) -> str:
    """The byte scene as a raster file."""
    pixels = Q.byte_scene(spark, sf_dir)
    h, w = denoise.size_of(pixels)
    out = f"{folder(spark)}/scene.tif"
    tiff.write_tiff(tiff.to_tiles(pixels, 64), out, h, w, 3, [500000.0, 2.0, 0.0, 4000000.0, 0.0, -2.0], "local", 64, nodata=128)
    return out


# --- raster files -----------------------------------------------------------------------------------------


@query("sk1_raster_round_trip", f"WITH {Q._BYTE} SELECT c, y, x, v FROM bpix")
def raster_round_trip(spark, sf_dir):
    return tiff.read_window(spark, stored_scene(spark, sf_dir)).select("c", "y", "x", "v")


@query("sc7_file_window", f"WITH {Q._BYTE} SELECT c, y - 40 AS y, x - 10 AS x, v FROM bpix WHERE y BETWEEN 40 AND 71 AND x BETWEEN 10 AND 41 AND c IN (1, 3)")
def file_window(spark, sf_dir):
    rows = tiff.read_window(spark, stored_scene(spark, sf_dir), [1, 3], 40, 10, 32, 32)
    return rows.select("c", (F.col("y") - 40).alias("y"), (F.col("x") - 10).alias("x"), "v")


@query("sc2_file_header", f"WITH {Q._PIX} SELECT 'scene' AS name, w AS width, h AS height, 3 AS n_bands, 'uint8' AS dtype, 500000.0::DOUBLE AS gx, 2.0::DOUBLE AS dx, 4000000.0::DOUBLE AS gy, 'local' AS wkt, 128.0::DOUBLE AS nodata FROM dim")
def file_header(spark, sf_dir):
    name = F.regexp_extract("path", "([^/]+)[.][^./]*$", 1)
    return tiff.read_headers(spark, stored_scene(spark, sf_dir)).select(name.alias("name"), "width", "height", "n_bands", "dtype", F.col("gt")[0].alias("gx"), F.col("gt")[1].alias("dx"), F.col("gt")[3].alias("gy"), "wkt", F.col("nodata")[0].alias("nodata"))


@query("sc1_raster_files", "SELECT CAST(row_number() OVER (ORDER BY name) AS INT) AS place, name FROM (SELECT replace(n_name, ' ', '_') || CASE n_nationkey % 3 WHEN 0 THEN '.tif' WHEN 1 THEN '.tiff' ELSE '.sid' END AS name FROM nation WHERE n_nationkey % 4 < 3)")
def raster_files(spark, sf_dir):
    """Files of three extensions in folders, and others beside them; sorted by name, as their folders have equal names."""
    at = folder(spark)
    for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").collect():  # a file a nation
        kind = ("tif", "tiff", "sid")[r.n_nationkey % 3] if r.n_nationkey % 4 < 3 else "txt"
        with open(f"{at}/{r.n_name.replace(' ', '_')}.{kind}", "wb") as file:
            file.write(b"II")
    names = tiff.list_rasters(spark, at).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    return names.select(F.row_number().over(Window.orderBy("name")).alias("place"), "name")  # a row a file


@query("sk2_preview_file", f"WITH {Q._BYTE}, s AS (SELECT h, w, greatest(1.0, greatest(h, w) / 100.0) AS f FROM dim), o AS (SELECT h, w, CAST(greatest(1, round_even(h / f, 0)) AS INT) AS mh, CAST(greatest(1, round_even(w / f, 0)) AS INT) AS mw FROM s), oy AS (SELECT unnest(range(mh)) AS dy, h, mh FROM o), ox AS (SELECT unnest(range(mw)) AS dx, w, mw FROM o) SELECT c, CAST(dy AS INT) AS y, CAST(dx AS INT) AS x, CAST(v AS INT) AS v FROM bpix JOIN oy ON y = floor((dy + 0.5) * h / mh) JOIN ox ON x = floor((dx + 0.5) * w / mw)")
def preview_file(spark, sf_dir):
    pixels, out = Q.byte_scene(spark, sf_dir), f"{folder(spark)}/preview.png"
    h, w = denoise.size_of(pixels)
    s = max(1.0, max(h, w) / 100)
    tiff.write_png(resample.decimate(pixels, (h, w), 100), out, max(1, round(h / s)), max(1, round(w / s)))
    return spark.createDataFrame(tiff.png_pixels(open(out, "rb").read()), "c int, y int, x int, v int")


@query("sk10_polygon_round_trip", f"WITH {Q._MASK} SELECT split, CAST(row_number() OVER (PARTITION BY split ORDER BY x0, y0, x1, y1) - 1 AS INT) AS geom_id, x0, y0, x1, y1, 4 AS points FROM box")
def polygon_round_trip(spark, sf_dir):
    at = folder(spark)
    boxes: dict = {}
    for r in Q.masks(spark, sf_dir).orderBy("split", "x0", "y0", "x1", "y1").collect():  # masks drawn by hand
        boxes.setdefault(r.split, []).append((r.x0, r.y0, r.x1, r.y1))
    for split, own in boxes.items():
        vector.write_boxes(f"{at}/{split}.shp", own)
    rows = vector.read_polygons(spark, at)
    return rows.select(F.regexp_extract("path", "([^/]+)[.]shp$", 1).alias("split"), "geom_id", "x0", "y0", "x1", "y1", F.size("ring").alias("points"))


# --- the patch index and its samples ----------------------------------------------------------------------

_AREA = (("train", 0, 0, 40, 64), ("train", 20, 10, 64, 30), ("val", 30, 0, 64, 64))
_CONFIG = DatasetConfig(patch_size=SIZE, stride=STEP, lr_patch_size=SMALL, bands=(1,), overlap_threshold=0.5, max_nodata_ratio=0.2, nodata_value=0.0)


def _rasters(spark, sf_dir):
    gt = F.array(*map(F.lit, (0.0, 1.0, 0.0, 64.0, 0.0, -1.0)))
    pixels = Q.sparse(spark, sf_dir).select("path", F.lit(1).alias("c"), "y", "x", "v")
    rasters = pixels.select("path").distinct().select("path", F.lit(64).alias("width"), F.lit(64).alias("height"), gt.alias("gt"), F.lit("local").alias("wkt"), F.array(F.lit(0.0)).alias("nodata"))
    return rasters, spark.createDataFrame([(s, *map(float, b)) for s, *b in _AREA], "split string, x0 double, y0 double, x1 double, y1 double"), pixels


_INDEX = f"""{Q._SPARSE}, {Q._WIN}, area(split, x0, y0, x1, y1) AS (VALUES {", ".join(map(str, _AREA))}),
inside AS (SELECT path, split, x_offset, y_offset, count(DISTINCT j * 1000 + i) / {SIZE * SIZE}.0 AS overlap_ratio FROM win, range({SIZE}) a(i), range({SIZE}) b(j), area
    WHERE x_offset + j >= x0 AND x_offset + j < x1 AND 63 - (y_offset + i) >= y0 AND 63 - (y_offset + i) < y1 GROUP BY ALL),
rated AS (SELECT win.path, x_offset, y_offset, coalesce(avg(CASE WHEN {Q._ND} THEN 1.0 WHEN v IS NOT NULL THEN 0.0 END), 0) AS nodata_ratio
    FROM win LEFT JOIN sparse s ON win.path = s.path AND y BETWEEN y_offset AND y_offset + {SIZE - 1} AND x BETWEEN x_offset AND x_offset + {SIZE - 1} GROUP BY ALL),
patch AS (SELECT inside.*, nodata_ratio FROM inside JOIN rated ON inside.path = rated.path AND inside.x_offset = rated.x_offset AND inside.y_offset = rated.y_offset WHERE overlap_ratio >= 0.5 AND nodata_ratio <= 0.2)"""
_PATCHES = "SELECT path, split, CAST(x_offset AS INT) AS x_offset, CAST(y_offset AS INT) AS y_offset, round(overlap_ratio, 9) AS overlap_ratio, round(nodata_ratio, 6) AS nodata_ratio FROM patch"


def _patches(spark, sf_dir):
    return dataset.patch_index(*_rasters(spark, sf_dir), _CONFIG)


def _index_row(index: DataFrame) -> DataFrame:
    return index.select("path", "split", "x_offset", "y_offset", F.round("overlap_ratio", 9).alias("overlap_ratio"), F.round("nodata_ratio", 6).alias("nodata_ratio"))


@query("rt10_patch_index", f"WITH {_INDEX} {_PATCHES}")
def patch_index(spark, sf_dir):
    return _index_row(_patches(spark, sf_dir))


@query("sk6_stored_index", f"WITH {_INDEX} {_PATCHES}")
def stored_index(spark, sf_dir):
    """The index written once; the second call finds it and reads it."""
    at, parts = folder(spark), _rasters(spark, sf_dir)
    dataset.stored_patch_index(spark, at, *parts, _CONFIG)
    return _index_row(dataset.stored_patch_index(spark, at, *parts, _CONFIG))


@query("ag13_counts", f"WITH {Q._PIX}{Q._VIEWS}, {_INDEX} SELECT (SELECT count(*) FROM tile) AS tiles, (SELECT count(*) FROM patch WHERE split = 'train') AS patches")
def counts(spark, sf_dir):
    tiles = tiling.views(spark, *Q.shape(spark, sf_dir), Q.TILE, Q.STRIDE).count()
    return _patches(spark, sf_dir).where("split = 'train'").agg(F.lit(tiles).cast("long").alias("tiles"), F.count("*").alias("patches"))


@query("so5_shuffled_index", f"WITH {_INDEX} SELECT CAST(row_number() OVER (ORDER BY md5(concat_ws('|', path, x_offset, y_offset, 3, 1)), path, x_offset, y_offset) AS INT) AS place, path, CAST(x_offset AS INT) AS x_offset, CAST(y_offset AS INT) AS y_offset FROM patch WHERE split = 'val'")
def shuffled_index(spark, sf_dir):
    rows = dataset.shuffled(_patches(spark, sf_dir).where("split = 'val'"), epoch=1, seed=3).select("path", "x_offset", "y_offset").toArrow().to_pylist()  # the order is what is asked for
    return spark.createDataFrame([(i, r["path"], r["x_offset"], r["y_offset"]) for i, r in enumerate(rows, 1)], "place int, path string, x_offset int, y_offset int")


def _axis(name: str, source: str, weights: str, of: str, other: str, after: str = "{}") -> str:
    value = after.format("sum(s.v * w.wt)")
    return f"{name} AS (SELECT path, px, py, {other}, CAST(w.d AS INT) AS {of}, {value} AS v FROM {source} s JOIN {weights} w ON s.{of} = w.k GROUP BY path, px, py, {other}, w.d)"


_HELD = "round_even(least(greatest({}, 0.0), 255.0), 0)"
_SAMPLE = f"""{_INDEX}, dim AS (SELECT 1 AS one), {Q._area("down", str(SIZE), str(SMALL))}, {Q._cubic("up", str(SMALL), str(SIZE))},
cell AS (SELECT DISTINCT p.path, x_offset AS px, y_offset AS py, CAST(y - y_offset AS INT) AS i, CAST(x - x_offset AS INT) AS j, CASE WHEN {Q._ND} THEN 0.0 ELSE v * 30 END AS v FROM patch p JOIN sparse s ON p.path = s.path AND y BETWEEN y_offset AND y_offset + {SIZE - 1} AND x BETWEEN x_offset AND x_offset + {SIZE - 1}),
{_axis("a", "cell", "down", "j", "i")},
{_axis("b", "a", "down", "i", "j", _HELD)},
{_axis("d", "b", "up", "j", "i")},
{_axis("e", "d", "up", "i", "j", _HELD)}"""


@query("rt9_samples", f"WITH {_SAMPLE} SELECT cell.path, CAST(cell.px AS INT) AS x_offset, CAST(cell.py AS INT) AS y_offset, 1 AS c, cell.i, cell.j, round(cell.v / 255 * 2 - 1, 6) AS hr, round(e.v / 255 * 2 - 1, 6) AS lr FROM cell JOIN e ON cell.path = e.path AND cell.px = e.px AND cell.py = e.py AND cell.i = e.i AND cell.j = e.j")
def samples(spark, sf_dir):
    """Read, NoData to 0, degrade, scale: from the index to pairs in one plan."""
    rasters, masks, pixels = _rasters(spark, sf_dir)
    index = dataset.patch_index(rasters, masks, pixels, _CONFIG)
    patch = dataset.patch_pixels(index, rasters, pixels.withColumn("v", F.col("v") * 30), _CONFIG)
    return Q._rounded(dataset.samples(patch, _CONFIG), "hr", "lr")


# --- stored tables ----------------------------------------------------------------------------------------


@query("sk9_stored_pyramid", f"WITH {Q._BYTE} SELECT l AS level, c, CAST(y // l AS INT) AS oy, CAST(x // l AS INT) AS ox, round_even(avg(v), 0) AS v FROM bpix, (VALUES (8), (16), (32)) t(l) GROUP BY ALL")
def stored_pyramid(spark, sf_dir):
    return dataset.stored_pyramid(spark, folder(spark), Q.byte_scene(spark, sf_dir), byte=True)


@query("sk5_stored_maps", f"WITH {Q._PIX}{Q._COVER} SELECT y, x, round(sum(wt), 6) AS wsum, round(sum(wt * wt), 6) AS w2sum FROM cov WHERE c = 1 GROUP BY y, x")
def stored_maps(spark, sf_dir):
    at, dims = folder(spark), Q.shape(spark, sf_dir)
    denoise.stored_maps(spark, at, dims, Q.TILE, Q.STRIDE)
    return Q._rounded(denoise.stored_maps(spark, at, dims, Q.TILE, Q.STRIDE), "wsum", "w2sum")


@query("sc12_resumed_chain", f"WITH {Q._UNIT} SELECT c, y, x, round(v, 4) AS v FROM unit")
def resumed_chain(spark, sf_dir):
    """A chain of four steps, interrupted after two, and taken up from what was committed; it ends at the condition."""
    config, at, scene = InferConfig(patch_size=Q.TILE, stride=Q.STRIDE, bands=(1, 2), seed=5, steps=4, save_every=2), folder(spark), Q.scene(spark, sf_dir)
    denoise.denoise(scene, config, f"{at}/state", stop_after=2)
    return denoise.denoise(scene, config, f"{at}/state").withColumn("v", F.round("v", 4))


# --- names, settings, systems -----------------------------------------------------------------------------


@query("pj13_names", "SELECT p_partkey, regexp_extract(path, '([^/]+)$', 1) AS file, regexp_replace(regexp_extract(path, '([^/]+)$', 1), '[.][^.]*$', '') || '_sr.tif' AS made FROM (SELECT p_partkey, '/data/' || replace(p_type, ' ', '/') || '.x.tif' AS path FROM part)")
def names(spark, sf_dir):
    path = F.concat(F.lit("/data/"), F.replace("p_type", F.lit(" "), F.lit("/")), F.lit(".x.tif"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", C.file_name(path).alias("file"), F.concat(C.base_name(path), F.lit("_sr.tif")).alias("made"))


@query("pj15_ranges", "SELECT n_nationkey, CAST(n_nationkey - 5 AS DOUBLE) AS lo, CAST(n_nationkey * 1.5 AS DOUBLE) AS hi FROM nation")
def ranges(spark, sf_dir):
    keys = [r[0] for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey").collect()]  # an option a run
    return spark.createDataFrame([(k, *norm_range(f"{k - 5},{k * 1.5}")) for k in keys], "n_nationkey int, lo double, hi double")


@query("sc16_settings", "SELECT * FROM (VALUES ('bands', '[1, 3]'), ('lr_patch_size', '32'), ('masks', '[(''test'', None), (''train'', ''a.shp'')]'), ('max_nodata_ratio', '0.2'), ('nodata_value', 'None'), ('overlap_threshold', '0.8'), ('patch_size', '128'), ('root_dir', '/data'), ('stride', '64')) t(name, value)")
def settings(spark, sf_dir):
    c = config_of({"dataset": {"root_dir": "/data", "masks": {"train": "a.shp", "test": None}, "patch_size": 128, "stride": 64, "lr_patch_size": 32, "bands": [1, 3]}}).dataset
    return spark.createDataFrame([(k, str(list(v) if isinstance(v, tuple) else v)) for k, v in asdict(c).items()], "name string, value string")


@query("pj17_mask_boxes", f"WITH {Q._HEAD}, two AS (SELECT path, {Q._corner('10', '20')[0]} AS ax, {Q._corner('10', '20')[1]} AS ay, {Q._corner('50', '60')[0]} AS bx, {Q._corner('50', '60')[1]} AS by_ FROM head) SELECT path, least(ax, bx) AS x0, least(ay, by_) AS y0, greatest(ax, bx) AS x1, greatest(ay, by_) AS y1 FROM two")
def mask_boxes(spark, sf_dir):
    return Q.headers(spark, sf_dir).select("path", *[c.alias(k) for k, c in C.pixel_box(F.col("gt"), 10, 20, 50, 60).items()])


def _series(kind: str, c: tuple[float, ...], sign: str) -> str:
    a, b = ("sin", "cosh") if kind == "n" else ("cos", "sinh")
    return "".join(f" {sign} {v!r}::DOUBLE * {a}({2 * j} * xi) * {b}({2 * j} * eta)" for j, v in enumerate(c, 1))


_GEO = f"""pt AS (SELECT c_custkey AS k, 500000 + (c_custkey % 700 - 350) * 800.0 AS ux, (c_custkey % 900 + 1) * 9000.0 AS uy FROM customer),
p1 AS (SELECT k, ux, uy, uy / ({geodesy.SCALE * geodesy.RADIUS!r}::DOUBLE) AS xi, (ux - 500000) / ({geodesy.SCALE * geodesy.RADIUS!r}::DOUBLE) AS eta FROM pt),
p2 AS (SELECT k, ux, uy, xi{_series("n", geodesy.BETA, "-")} AS n, eta{_series("e", geodesy.BETA, "-")} AS e FROM p1),
p3 AS (SELECT *, asin(sin(n) / cosh(e)) AS chi FROM p2),
geo AS (SELECT k, degrees(atan2(sinh(e), cos(n))) - 123 AS lon, degrees(chi{"".join(f" + {d!r}::DOUBLE * sin({2 * j} * chi)" for j, d in enumerate(geodesy.DELTA, 1))}) AS lat FROM p3)"""


@query("jn11_reprojected", f"WITH {_GEO} SELECT k, round(lon, 8) AS lon, round(lat, 8) AS lat FROM geo")
def reprojected(spark, sf_dir):
    k = F.col("c_custkey")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("k"), ((k % 700 - 350) * 800.0 + 500000).alias("ux"), ((k % 900 + 1) * 9000.0).alias("uy"))
    lon, lat = geodesy.moved(F.col("ux"), F.col("uy"), "WGS 84 / UTM zone 10N", "EPSG:4326")
    return rows.select("k", F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


@query("ag15_mean_scale", f"WITH {Q._HEAD} SELECT path, level, round((width / ceil(width / CAST(level AS DOUBLE)) + height / ceil(height / CAST(level AS DOUBLE))) / 2, 6) AS scale FROM head, (VALUES (8), (16), (32)) t(level)")
def mean_scale(spark, sf_dir):
    lv = Q.headers(spark, sf_dir).select("path", "width", "height", F.explode(F.array(*map(F.lit, (8, 16, 32)))).alias("level"))
    cells = lambda c: F.ceil(F.col(c) / F.col("level"))
    return lv.select("path", "level", F.round(resample.mean_scale(F.col("width"), F.col("height"), cells("width"), cells("height")), 6).alias("scale"))


# --- diffusion --------------------------------------------------------------------------------------------


@query("fl7_saved_steps", f"SELECT CAST(t AS INT) AS t FROM range({Q.STEPS}) r(t) WHERE t % 300 = 0")
def saved_steps(spark, sf_dir):
    return D.schedule(spark, Q.STEPS).where(denoise.is_saved(F.col("t"), 300)).select("t")


@query("df6_reverse_sample", f"WITH {Q._UNIT}, {Q._SCHEDULE}, {Q._AT} SELECT c, y, x, round(coef1 * {Q._REV} + coef2 * e + CASE WHEN at_.t = 0 THEN 0 ELSE v * exp(post_logvar / 2) END, 6) AS v FROM at_ JOIN step ON at_.t = step.t")
def reverse_sample(spark, sf_dir):
    rows = Q._at(spark, sf_dir).select("c", "y", F.col("x").alias("gx"), "t", F.col("e").alias("x"), "v")
    out = D.reverse_sample(rows, D.schedule(spark, Q.STEPS), D.oracle_noise(F.col("r.v"), F.col("r.x")), F.col("r.v"))
    return out.select("c", "y", F.col("gx").alias("x"), F.round("sample", 6).alias("v"))


@query("jn8_stacked", f"WITH {Q._UNIT}, {Q._AT} SELECT c, y, x, {Q._r()} FROM at_ UNION ALL SELECT c + 2, y, x, round(e, 6) FROM at_")
def stacked(spark, sf_dir):
    rows = Q._at(spark, sf_dir)
    return Q._rounded(D.stacked(rows.select("c", "y", "x", "v"), rows.select("c", "y", "x", F.col("e").alias("v")), 2), "v")


def _oracle(spark, steps: int):
    by_level = {round(r.acp**0.5, 12): r for r in D.schedule(spark, steps).collect()}  # a row a step
    return lambda cond, x, level: (x - by_level[round(level, 12)].sqrt_acp * cond) / by_level[round(level, 12)].sqrt_1m


_STRIP = "strip AS (SELECT y AS sample, c, x AS j, v FROM unit WHERE x < 8)"


def _strips(spark, sf_dir):
    return denoise.normalised(Q.scene(spark, sf_dir), (1, 2)).where("x < 8").select(F.col("y").cast("long").alias("sample"), "c", F.col("x").alias("j"), "v")


@query("df8_patch_chain", f"WITH {Q._UNIT}, {_STRIP} SELECT CAST(sample AS BIGINT) AS sample, c, j, round(v, 4) AS v FROM strip")
def patch_chain(spark, sf_dir):
    """The whole chain of every row as a patch of its own, by the closed-form predictor: it ends at the condition."""
    rows = _strips(spark, sf_dir).groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("c", "j", "v"))).alias("cells"))
    made = denoise.sample_chain(rows.select("sample", F.col("cells.v").alias("cond")), D.schedule(spark, 6), _oracle(spark, 6), (2, 1, 8), 3)
    out = made.select("sample", F.posexplode("made").alias("k", "v"))
    return out.select("sample", (F.expr("k div 8") + 1).cast("int").alias("c"), F.expr("k % 8").alias("j"), F.round("v", 4).alias("v"))


@query("df13_validation", f"WITH {Q._UNIT}, {_STRIP}, first AS (SELECT * FROM strip WHERE sample < 8) SELECT round(avg(abs(v - v / 2)), 6) AS loss, count(*) AS pixels, count(DISTINCT sample) AS samples FROM first")
def validation(spark, sf_dir):
    """The chain of the first samples, whose target is half their condition: a loss and the images behind it."""
    steps = D.schedule(spark, 6)
    rows = _strips(spark, sf_dir).select("sample", "c", F.lit(0).alias("y"), F.col("j").alias("x"), (F.col("v") / 2).alias("v"), F.col("v").alias("cond"))
    loss, images = training.validate(rows, steps, _oracle(spark, 6), (2, 1, 8))
    return images.agg(F.round(F.lit(loss), 6).alias("loss"), F.count("*").alias("pixels"), F.countDistinct("sample").alias("samples"))


_W = (0.1, 0.5, -0.25, 0.05, 0.2, -0.1)
_MISS = f"{_W[0]} + {_W[1]} * noisy + {_W[2]} * v + {_W[3]} * level + {_W[4]} * level * noisy + {_W[5]} * level * v - e"
_GRADS = ("1.0", "noisy", "v", "level", "level * noisy", "level * v")


@query("df14_optimiser_step", f"""WITH {Q._UNIT}, {Q._SCHEDULE}, {Q._TRAIN}, miss AS (SELECT *, {_MISS} AS m FROM nz),
g AS (SELECT unnest({list(training.FEATURES)}) AS name, unnest([{", ".join(f"avg(sign(m) * {f})" for f in _GRADS)}]) AS g, unnest({list(_W)}) AS w, avg(abs(m)) AS loss FROM miss)
SELECT name, round(loss, 6) AS loss, round(g, 6) AS gradient, round(w * (1 - 0.001 * 0.01) - 0.001 * g / (sqrt(g * g) + 1e-8), 8) AS weight FROM g""")
def optimiser_step(spark, sf_dir):
    import numpy as np

    u = denoise.normalised(Q.scene(spark, sf_dir), (1, 2)).select(F.col("y").alias("sample"), "c", "x", "v")
    pairs = D.training_pairs(u, D.schedule(spark, Q.STEPS), F.expr("sample div 8"), seed=1).withColumn("cond", F.col("v"))
    row = training.gradient(pairs, np.array(_W)).first()
    own = training.Optimiser(np.array(_W))
    own.step(np.array([row[k] for k in training.FEATURES]), 0.001, 0.01)
    return spark.createDataFrame([(k, round(row.loss, 6), round(row[k], 6), round(float(w), 8)) for k, w in zip(training.FEATURES, own.weights, strict=True)], "name string, loss double, gradient double, weight double")


@query("wn2_tiles_by_band", f"WITH {Q._PIX}{Q._VIEWS} SELECT c, count(*) AS tiles FROM tile, (SELECT DISTINCT c FROM pix) GROUP BY c")
def tiles_by_band(spark, sf_dir):
    """Tiles that each band of the scene takes part in, from the expansion of pixels."""
    rows = tiling.covered(Q.scene(spark, sf_dir), *Q.shape(spark, sf_dir), Q.TILE, Q.STRIDE)
    return rows.select("c", "h0", "w0").distinct().groupBy("c").agg(F.count("*").alias("tiles"))


@query("fl8_touching_masks", f"WITH {Q._AREAS} SELECT path, count(*) AS masks, CAST(sum(CASE WHEN {Q._SHARED} > 0 THEN 1 ELSE 0 END) AS BIGINT) AS overlapping FROM ext JOIN box ON {Q._TOUCH} GROUP BY path")
def touching_masks(spark, sf_dir):
    hit = spatial.meeting(spatial.with_extent(Q.headers(spark, sf_dir)), Q.masks(spark, sf_dir))
    return hit.groupBy("path").agg(F.count("*").alias("masks"), F.sum(F.when(spatial.shared_area() > 0, 1).otherwise(0)).alias("overlapping"))


# --- whole commands ---------------------------------------------------------------------------------------

_QUARTER = f"""{Q._BYTE}, {Q._area("ax", "w", "(w // 4)")}, {Q._area("ay", "h", "(h // 4)")}, {Q._cubic("ux", "(w // 4)", "w")}, {Q._cubic("uy", "(h // 4)", "h")},
{Q._two("low_", "bpix", "ax", "ay", _HELD)},
{Q._two("sr", "low_", "ux", "uy", _HELD)}"""


def _commands():
    from gridloom.plans import commands

    return commands


def _pair(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    return _commands().degrade_scene(spark, stored_scene(spark, sf_dir), folder(spark), 4)


def _raster(spark: SparkSession, path: str) -> DataFrame:
    return tiff.read_window(spark, path).select("c", "y", "x", "v")


@query("sk7_degraded_pair", f"WITH {_QUARTER} SELECT 'hr' AS kind, c, y, x, v FROM bpix UNION ALL SELECT 'sr', c, y, x, v FROM sr")
def degraded_pair(spark, sf_dir):
    rows = [_raster(spark, p).select(F.lit(kind).alias("kind"), "c", "y", "x", "v") for kind, p in zip(("hr", "sr"), _pair(spark, sf_dir), strict=True)]
    return rows[0].union(rows[1])


@query("sk8_projected_raster", f"""WITH {_QUARTER}, two AS (SELECT sr.c, sr.y, sr.x, sr.v AS a, bpix.v AS b FROM sr JOIN bpix ON sr.c = bpix.c AND sr.y = bpix.y AND sr.x = bpix.x), gap AS (SELECT c, y, x, b - a AS v FROM two),
{Q._two("glow", "gap", "ax", "ay")},
{Q._two("gup", "glow", "ux", "uy")} SELECT two.c, two.y, two.x, round_even(least(greatest(a + gup.v, 0.0), 255.0), 0) AS v FROM two JOIN gup ON two.c = gup.c AND two.y = gup.y AND two.x = gup.x""")
def projected_raster(spark, sf_dir):
    hr, sr = _pair(spark, sf_dir)
    out = f"{folder(spark)}/projected.tif"
    _commands().project(spark, sr, hr, out, 4)
    return _raster(spark, out)


@query("ap6_inferred_raster", f"WITH {Q._BYTE} SELECT c, y, x, v FROM bpix WHERE c <= 2")
def inferred_raster(spark, sf_dir):
    """A scene denoised from file to file by the closed-form predictor, over a given range: it ends at its input."""
    config = InferConfig(patch_size=Q.TILE, stride=Q.STRIDE, bands=(1, 2), steps=3, save_every=2, norm_range=(0.0, 255.0))
    return _raster(spark, _commands().infer(spark, stored_scene(spark, sf_dir), f"{folder(spark)}/out.tif", config))


@query("ap11_demo_scene", f"{Q._SYNTHETIC} SELECT CAST(own.c AS INT) AS c, own.y, own.x, round_even(least(greatest((0.75 * shape.v + 0.25 * own.v) * [1.00, 0.92, 0.78][own.c] * 255, 20.0), 235.0), 0) AS v FROM own JOIN shape ON own.y = shape.y AND own.x = shape.x")
def demo_scene(spark, sf_dir):
    at = folder(spark)
    _commands().demo(spark, at, 64, 4)
    return _raster(spark, f"{at}/scene.tif")


@query("rt11_image_grid", f"""WITH {Q._PIX}, im AS (SELECT a.y // 16 AS sample, a.y % 16 AS i, a.x AS j, a.v AS lr, b.v AS made, d.v AS hr FROM pix a JOIN pix b ON a.y = b.y AND a.x = b.x AND b.c = 2 JOIN pix d ON a.y = d.y AND a.x = d.x AND d.c = 3 WHERE a.c = 1 AND a.x < 16 AND a.y < 128),
cs AS (SELECT sample * 18 + 2 + i AS y, col * 18 + 2 + j AS x, u FROM (SELECT sample, i, j, unnest([0, 1, 2]) AS col, unnest([lr, made, hr]) AS u FROM im)),
page AS (SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM range(146) a(y), range(56) b(x))
SELECT 1 AS c, page.y, page.x, CAST(CASE WHEN u IS NULL THEN 0 ELSE round_even((greatest(-1, least(1, u)) + 1) / 2 * 255, 0) END AS INT) AS v FROM page LEFT JOIN cs ON page.y = cs.y AND page.x = cs.x""")
def image_grid(spark, sf_dir):
    """The grid of the first eight samples as an image file; its size is its feature."""
    s, out = Q.scene(spark, sf_dir).where("x < 16 and y < 128"), f"{folder(spark)}/grid.png"
    im = s.groupBy("y", F.col("x").alias("j")).agg(*[F.max(F.when(F.col("c") == c, F.col("v"))).alias(n) for c, n in ((1, "lr"), (2, "made"), (3, "hr"))])
    im = im.select(F.expr("cast(y div 16 as int)").alias("sample"), F.lit(1).alias("c"), F.expr("y % 16").alias("i"), "j", "lr", "made", "hr")
    tiff.write_png(dataset.comparison_grid(im, 16).withColumn("v", F.col("v") * 255), out, 8 * 18 + 2, 3 * 18 + 2)
    return spark.createDataFrame(tiff.png_pixels(open(out, "rb").read()), "c int, y int, x int, v int")


_MOVED = "w * (1 - 0.001) - 0.1 * g / (abs(g) + 1e-8)"


@query("rt13_resumed_optimiser", f"""WITH w0 AS (SELECT unnest({list(training.FEATURES)}) AS name, unnest([(c_custkey % 7 - 3.0) / 4 + 0.1 FOR c_custkey IN range(6)]) AS g, 0.0::DOUBLE AS w),
w1 AS (SELECT name, g, {_MOVED} AS w FROM w0), w2 AS (SELECT name, g, {_MOVED} AS w FROM w1), w3 AS (SELECT name, g, {_MOVED} AS w FROM w2) SELECT name, round(w, 8) AS weight, 3 AS steps FROM w3""")
def resumed_optimiser(spark, sf_dir):
    """Three steps of one gradient, each from what the last one left in the newest checkpoint."""
    import numpy as np

    from gridloom.sources.store import Snapshots

    store, g = Snapshots(spark, f"{folder(spark)}/checkpoints", "epoch"), np.array([(k % 7 - 3.0) / 4 + 0.1 for k in range(len(training.FEATURES))])
    for epoch in range(3):
        done = store.committed()
        own = training.Optimiser.of(store.read(done[-1])) if done else training.Optimiser()
        own.step(g, 0.1, 0.01)
        store.write(own.table(spark), epoch)
    return store.read(store.committed()[-1]).select("name", F.round("weight", 8).alias("weight"), "steps")
