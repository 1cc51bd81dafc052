"""Queries over the driver's tables read as rasters, and independent SQL for the same rows.

`embeddings` is a scene: y is vec_id, x the index of the component, and three bands are made of its
value e (e, |e|, -e/2). `events` is a sparse raster of users and hours, whose gaps are NoData.
`supplier` and `nation` give headers and masks. The SQL is written on its own, with range joins
where the plans use arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import columns as C
from gridloom.operators import diffusion as D
from gridloom.operators import fusion, resample, spatial, tiling
from gridloom.plans import dataset, denoise
from gridloom.plans.config import DatasetConfig, InferConfig

TILE, STRIDE, LOW, STEPS, SEED = 32, 24, 5, 2000, 7
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# --- the scenes -------------------------------------------------------------------------------------------


def scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("int").alias("y"), F.posexplode("embedding").alias("x", "e"))
    e = e.select("y", "x", F.col("e").cast("double").alias("e"))
    return e.select("y", "x", F.posexplode(F.array("e", F.abs("e"), -F.col("e") / 2)).alias("c", "v")).select((F.col("c") + 1).alias("c"), "y", "x", "v")


def byte_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene(spark, sf_dir).withColumn("v", C.byte_of_signed(F.col("v") * 2).cast("double"))


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path = event type; y = user modulo 64, x = hour modulo 64; v = rounded sum of values, 0 (NoData) where it rounds to 0."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    y, x = F.pmod("user_id", F.lit(64)).cast("int"), F.pmod(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000), F.lit(64)).cast("int")
    return e.groupBy(F.col("event_type").alias("path"), y.alias("y"), x.alias("x")).agg(F.rint(F.sum(F.coalesce("value", F.lit(0.0))) % 7).alias("v"))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster a nation: its size and place follow from its key."""
    k = F.col("n_nationkey")
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    gt = F.array(*[x.cast("double") for x in (500000 + k * 130, F.lit(1), (k % 3) * 0.125, 4000000 - (k % 5) * 170, (k % 2) * 0.25, F.lit(-1))])
    return n.select(F.col("n_name").alias("path"), (100 + k * 7).cast("int").alias("width"), (90 + (k % 7) * 20).cast("int").alias("height"), gt.alias("gt"), F.lit("local").alias("wkt"), F.when(k % 3 == 0, F.array(F.lit(0.0), k.cast("double"))).alias("nodata"))


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping boxes of each of three splits."""
    r = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").alias("k")).withColumn("s", F.explode(F.array(*map(F.lit, range(3)))))
    k, s = F.col("k"), F.col("s")
    x0, y0 = (500000 + k * 700 + s * 90).cast("double"), (3999200 + s * 110 + k * 20).cast("double")
    return r.select(F.element_at(F.array(*map(F.lit, ("train", "val", "test"))), s + 1).alias("split"), x0.alias("x0"), y0.alias("y0"), (x0 + 620 + k * 31).alias("x1"), (y0 + 560).alias("y1")).union(
        r.select(F.element_at(F.array(*map(F.lit, ("train", "val", "test"))), s + 1), x0 + 200, y0 + 100, x0 + 900, y0 + 300)
    )


_PIX = """pix AS (SELECT c, y, x, CASE c WHEN 1 THEN e WHEN 2 THEN abs(e) ELSE -e / 2 END AS v FROM
    (SELECT CAST(vec_id AS INT) AS y, CAST(k - 1 AS INT) AS x, CAST(embedding[k] AS DOUBLE) AS e FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings)), (VALUES (1), (2), (3)) b(c)),
dim AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM pix)"""
_BYTE = _PIX + ",\nbpix AS (SELECT c, y, x, round_even((greatest(-1, least(1, v * 2)) + 1) / 2 * 255, 0) AS v FROM pix)"
_VIEWS = f""",
grid AS (SELECT h, w, (h - {TILE}) // {STRIDE} + 1 AS nh, (w - {TILE}) // {STRIDE} + 1 AS nw FROM dim),
hs AS (SELECT unnest(list_distinct(list_concat(range(0, h - {TILE} + 1, {STRIDE}), [h - {TILE}]))) AS h0 FROM dim),
ws AS (SELECT unnest(list_distinct(list_concat(range(0, w - {TILE} + 1, {STRIDE}), [w - {TILE}]))) AS w0 FROM dim),
tile AS (SELECT CAST(h0 AS INT) AS h0, CAST(w0 AS INT) AS w0 FROM hs, ws)"""
_RADIAL = f"1 - sqrt(pow(i - {TILE // 2}, 2) + pow(j - {TILE // 2}, 2)) / sqrt({2 * (TILE // 2) ** 2}) + 1e-4"
_COVER = _VIEWS + f""",
cov AS (SELECT *, {_RADIAL} AS wt FROM (SELECT c, y, x, v, h0, w0, y - h0 AS i, x - w0 AS j FROM pix JOIN tile ON y >= h0 AND y < h0 + {TILE} AND x >= w0 AND x < w0 + {TILE}))"""
_SPARSE = """sparse AS (SELECT event_type AS path, CAST(user_id % 64 AS INT) AS y, CAST((epoch_us(ts) // 3600000000) % 64 AS INT) AS x, round_even(sum(coalesce(value, 0.0)) % 7, 0) AS v FROM events GROUP BY ALL)"""
_HEAD = """head AS (SELECT n_name AS path, n_nationkey AS k, 100 + n_nationkey * 7 AS width, 90 + (n_nationkey % 7) * 20 AS height,
    [CAST(500000 + n_nationkey * 130 AS DOUBLE), 1.0, (n_nationkey % 3) * 0.125, CAST(4000000 - (n_nationkey % 5) * 170 AS DOUBLE), (n_nationkey % 2) * 0.25, -1.0] AS gt,
    CASE WHEN n_nationkey % 3 = 0 THEN [0.0, CAST(n_nationkey AS DOUBLE)] END AS nodata FROM nation)"""


def _corner(px: str, py: str) -> tuple[str, str]:
    return f"(gt[1] + ({px}) * gt[2] + ({py}) * gt[3])", f"(gt[4] + ({px}) * gt[5] + ({py}) * gt[6])"


def _box(x: str, y: str, w: str, h: str) -> str:
    cs = [_corner(f"{x} + {a}", f"{y} + {b}") for a in ("0", w) for b in ("0", h)]
    xs, ys = ", ".join(c[0] for c in cs), ", ".join(c[1] for c in cs)
    return f"least({xs}) AS minx, least({ys}) AS miny, greatest({xs}) AS maxx, greatest({ys}) AS maxy"


_MASK = """mask AS (SELECT ['train', 'val', 'test'][s + 1] AS split, unnest([[500000 + k * 700 + s * 90, 3999200 + s * 110 + k * 20, 500000 + k * 700 + s * 90 + 620 + k * 31, 3999200 + s * 110 + k * 20 + 560],
    [500200 + k * 700 + s * 90, 3999300 + s * 110 + k * 20, 500900 + k * 700 + s * 90, 3999500 + s * 110 + k * 20]]) AS b FROM (SELECT r_regionkey AS k, unnest([0, 1, 2]) AS s FROM region)),
box AS (SELECT split, CAST(b[1] AS DOUBLE) AS x0, CAST(b[2] AS DOUBLE) AS y0, CAST(b[3] AS DOUBLE) AS x1, CAST(b[4] AS DOUBLE) AS y1 FROM mask),
xs AS (SELECT split, x, lead(x) OVER (PARTITION BY split ORDER BY x) AS nx FROM (SELECT split, x0 AS x FROM box UNION SELECT split, x1 FROM box)),
ys AS (SELECT split, y, lead(y) OVER (PARTITION BY split ORDER BY y) AS ny FROM (SELECT split, y0 AS y FROM box UNION SELECT split, y1 FROM box)),
cell AS (SELECT DISTINCT xs.split, x AS x0, y AS y0, nx AS x1, ny AS y1 FROM xs JOIN ys ON xs.split = ys.split JOIN box ON box.split = xs.split AND box.x0 <= x AND box.x1 >= nx AND box.y0 <= y AND box.y1 >= ny)"""
_SHARED = "greatest(0, least(maxx, x1) - greatest(minx, x0)) * greatest(0, least(maxy, y1) - greatest(miny, y0))"
_TOUCH = "minx <= x1 AND x0 <= maxx AND miny <= y1 AND y0 <= maxy"


def _noise(keys: list[str], seed: int) -> str:
    total = " + ".join(f"CAST({k} AS BIGINT) * {m}" for k, m in zip(keys, C.NOISE_KEYS, strict=False))
    value = f"(({seed} + 1 + {total}) % {C.NOISE_MODULUS})"
    for add in C.NOISE_ROUNDS:
        value = f"(({value} * {C.NOISE_STEP} + {add}) % {C.NOISE_MODULUS})"
        value = f"(({value} * ({value} + {add})) % {C.NOISE_MODULUS})"
    return f"(({value} + 0.5) / {float(C.NOISE_MODULUS)}::DOUBLE)"


def _normal(keys: list[str], seed: int) -> str:
    return f"(sqrt(-2 * ln({_noise(keys, seed)})) * cos(2 * pi() * {_noise(keys, seed + 1000003)}))"


_SCHEDULE = f"""sch0 AS (SELECT CAST(t AS INT) AS t, {D.BETA_FIRST} + t * (({D.BETA_LAST} - {D.BETA_FIRST}) / {STEPS - 1}) AS beta FROM range({STEPS}) r(t)),
sch1 AS (SELECT *, 1 - beta AS alpha, exp(sum(ln(1 - beta)) OVER (ORDER BY t)) AS acp FROM sch0),
sch AS (SELECT *, coalesce(lag(acp) OVER (ORDER BY t), 1.0) AS acp_prev FROM sch1),
step AS (SELECT *, sqrt(1 / acp) AS sqrt_recip, sqrt(1 / acp - 1) AS sqrt_recipm1, beta * (1 - acp_prev) / (1 - acp) AS post_var,
    ln(greatest(beta * (1 - acp_prev) / (1 - acp), 1e-20)) AS post_logvar, beta * sqrt(acp_prev) / (1 - acp) AS coef1, (1 - acp_prev) * sqrt(alpha) / (1 - acp) AS coef2 FROM sch)"""


def _area(name: str, n: str, m: str) -> str:
    return f"""{name} AS (SELECT d, k, least((d + 1) * f, k + 1) - greatest(d * f, k) AS ov, (least((d + 1) * f, k + 1) - greatest(d * f, k)) / f AS wt
    FROM (SELECT CAST({n} AS DOUBLE) / {m} AS f, {n} AS n, unnest(range({m})) AS d FROM dim) a, LATERAL (SELECT unnest(range(n)) AS k) b WHERE least((d + 1) * f, k + 1) - greatest(d * f, k) > 1e-9)"""


def _cubic(name: str, n: str, m: str) -> str:
    return f"""{name} AS (SELECT d, greatest(0, least(n - 1, CAST(q AS BIGINT))) AS k, sum(CASE WHEN u <= 1 THEN 1.25 * u * u * u - 2.25 * u * u + 1 WHEN u < 2 THEN -0.75 * u * u * u + 3.75 * u * u - 6 * u + 3 ELSE 0 END) AS wt
    FROM (SELECT d, n, q, abs((d + 0.5) * n / m - 0.5 - q) AS u FROM (SELECT d, n, m, floor((d + 0.5) * CAST(n AS DOUBLE) / m - 0.5) + o AS q FROM (SELECT {n} AS n, {m} AS m, unnest(range({m})) AS d FROM dim), (VALUES (-1), (0), (1), (2)) t(o))) GROUP BY ALL)"""


def _two(name: str, source: str, wx: str, wy: str, after: str = "{}") -> str:
    value = after.format("sum(s.v * wy.wt)")
    return f"{name} AS (SELECT c, CAST(wy.d AS INT) AS y, x, {value} AS v FROM (SELECT c, y, CAST(wx.d AS INT) AS x, sum(p.v * wx.wt) AS v FROM {source} p JOIN {wx} wx ON p.x = wx.k GROUP BY c, y, wx.d) s JOIN {wy} wy ON s.y = wy.k GROUP BY c, wy.d, x)"


def _r(name: str = "v", alias: str | None = None) -> str:
    return f"round({name}, 6) AS {alias or name.split('.')[-1]}"


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def shape(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    return denoise.size_of(scene(spark, sf_dir))


def low(n: int) -> int:
    return max(1, n // LOW)


# --- scans and headers ------------------------------------------------------------------------------------


@query("sc5_band_select", f"WITH {_PIX} SELECT c, y, x, {_r()} FROM pix WHERE c IN (1, 3)")
def band_select(spark, sf_dir):
    return _rounded(scene(spark, sf_dir).where(F.col("c").isin(1, 3)), "v")


@query("sc6_first_bands", f"WITH {_PIX} SELECT c, count(*) AS n, round(sum(v), 4) AS total FROM pix WHERE c <= 2 GROUP BY c")
def first_bands(spark, sf_dir):
    return scene(spark, sf_dir).where("c <= 2").groupBy("c").agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"))


@query("sc4_window_read", f"WITH {_BYTE} SELECT c, y - 40 AS y, x - 10 AS x, CASE WHEN abs(v - 128) <= 1e-8 + 1e-5 * 128 THEN 0 ELSE v END AS v FROM bpix WHERE y BETWEEN 40 AND 71 AND x BETWEEN 10 AND 41")
def window_read(spark, sf_dir):
    own = byte_scene(spark, sf_dir).where(F.col("y").between(40, 71) & F.col("x").between(10, 41))
    return own.select("c", (F.col("y") - 40).alias("y"), (F.col("x") - 10).alias("x"), F.when(C.is_nodata(F.col("v"), F.lit(128.0)), 0.0).otherwise(F.col("v")).alias("v"))


@query("sc2_extent", f"WITH {_HEAD} SELECT path, {_box('0', '0', 'width', 'height')} FROM head")
def extent(spark, sf_dir):
    return spatial.with_extent(headers(spark, sf_dir)).select("path", "minx", "miny", "maxx", "maxy")


@query("sc3_nodata_lookup", f"WITH {_HEAD} SELECT path, nodata[2] AS band2, coalesce(CAST(5 AS DOUBLE), nodata[2]) AS given FROM head")
def nodata_lookup(spark, sf_dir):
    h = headers(spark, sf_dir)
    given = dataset.nodata_of(h, 2, 5.0).select("path", F.col("nodata_value").alias("given"))
    return dataset.nodata_of(h, 2).select("path", F.col("nodata_value").alias("band2")).join(given, "path")


@query("sc9_overview_pick", f"""WITH {_HEAD}, lv AS (SELECT path, level, width / ceil(width / CAST(level AS DOUBLE)) AS scale FROM head, (VALUES (8), (16), (32)) t(level)),
best AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY abs(scale - 16), level) AS nth FROM lv) SELECT path, level, round(scale, 6) AS scale, abs(scale - 16) / 16 < 0.5 AS fit FROM best WHERE nth = 1""")
def overview_pick(spark, sf_dir):
    lv = headers(spark, sf_dir).select("path", "width", F.explode(F.array(*map(F.lit, (8, 16, 32)))).alias("level"))
    return _rounded(resample.choose_overview(lv.select("path", "level", (F.col("width") / F.ceil(F.col("width") / F.col("level"))).alias("scale"))), "scale")


@query("sc15_latest_checkpoint", "SELECT arg_max('ckpt-' || o_orderkey, (o_orderdate, 'ckpt-' || o_orderkey)) AS path FROM orders")
def latest_checkpoint(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return dataset.latest(o.select(F.concat(F.lit("ckpt-"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderdate").alias("modificationTime")))


@query("pj12_cache_key", "SELECT 'train_ps512_s384_lr102_ot0.8_mn0.2_' || substr(md5(string_agg(n_name, '|' ORDER BY n_name)), 1, 8) AS cache_key FROM nation")
def cache_key(spark, sf_dir):
    return dataset.cache_key(headers(spark, sf_dir), "train", DatasetConfig(patch_size=512, stride=384, lr_patch_size=102))


# --- geometry ---------------------------------------------------------------------------------------------

_GX, _GY = _corner("l_linenumber * 3", "l_orderkey % 100")


@query("pj1_pixel_to_geo", f"WITH {_HEAD} SELECT DISTINCT path, l_linenumber AS px, l_orderkey % 100 AS py, round({_GX}, 6) AS gx, round({_GY}, 6) AS gy FROM lineitem JOIN head ON l_suppkey % 25 = k")
def pixel_to_geo(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_linenumber", (F.col("l_orderkey") % 100).alias("py"), (F.col("l_suppkey") % 25).alias("k")).distinct()
    h = headers(spark, sf_dir).withColumn("k", F.expr("cast((gt[0] - 500000) / 130 as int)"))
    gx, gy = C.to_geo(F.col("l_linenumber") * 3, F.col("py"), F.col("gt"))
    return li.join(h, "k").select("path", F.col("l_linenumber").alias("px"), "py", F.round(gx, 6).alias("gx"), F.round(gy, 6).alias("gy"))


@query("pj2_patch_box", f"WITH {_HEAD}, p AS (SELECT path, gt, width, height, unnest(range(0, width - 63, 48)) AS px FROM head), q AS (SELECT *, unnest(range(0, height - 63, 48)) AS py FROM p) SELECT path, CAST(px AS INT) AS x_offset, CAST(py AS INT) AS y_offset, {_box('px', 'py', '64', '64')} FROM q")
def patch_box(spark, sf_dir):
    grid = tiling.complete_windows(headers(spark, sf_dir), 64, 48)
    return grid.withColumns(C.box_of(F.col("gt"), F.col("x_offset"), F.col("y_offset"), F.lit(64), F.lit(64))).select("path", "x_offset", "y_offset", "minx", "miny", "maxx", "maxy")


@query("pj5_patch_geotransform", f"WITH {_HEAD} SELECT path, {_corner('10', '20')[0]} AS gx, gt[2] AS dx, gt[3] AS rx, {_corner('10', '20')[1]} AS gy, gt[5] AS ry, gt[6] AS dy FROM head")
def patch_geotransform(spark, sf_dir):
    g = headers(spark, sf_dir).withColumn("g", C.shifted(F.col("gt"), F.lit(10), F.lit(20)))
    return g.select("path", *[F.col("g")[i].alias(n) for i, n in enumerate(("gx", "dx", "rx", "gy", "ry", "dy"))])


@query("pj4_geo_window", f"""WITH {_HEAD}, {_MASK}, m AS (SELECT min(x0) AS a, min(y0) AS b, max(x1) AS c, max(y1) AS d FROM box WHERE split = 'val'),
o AS (SELECT path, width, height, CAST(trunc((a - gt[1]) / gt[2]) AS BIGINT) AS ox, CAST(trunc((d - gt[4]) / gt[6]) AS BIGINT) AS oy, ceil((c - a) / gt[2]) AS sw, ceil((b - d) / gt[6]) AS sh FROM head, m)
SELECT path, CAST(greatest(0, ox) AS INT) AS x_off, CAST(greatest(0, oy) AS INT) AS y_off, CAST(least(sw, width - greatest(0, ox)) AS INT) AS x_size, CAST(least(sh, height - greatest(0, oy)) AS INT) AS y_size FROM o""")
def geo_window(spark, sf_dir):
    m = masks(spark, sf_dir).where("split = 'val'").agg(F.min("x0").alias("a"), F.min("y0").alias("b"), F.max("x1").alias("c"), F.max("y1").alias("d"))
    h = headers(spark, sf_dir).crossJoin(F.broadcast(m))  # m: one row
    cols = C.window_of((F.col("a"), F.col("b"), F.col("c"), F.col("d")), F.col("gt"), F.col("width"), F.col("height"))
    return h.select("path", *[v.cast("int").alias(k) for k, v in cols.items()])


_AREAS = f"{_HEAD}, {_MASK}, ext AS (SELECT path, {_box('0', '0', 'width', 'height')} FROM head)"


@query("ag2_mask_union", f"WITH {_MASK} SELECT split, round(sum((x1 - x0) * (y1 - y0)), 6) AS area, min(x0) AS minx, min(y0) AS miny, max(x1) AS maxx, max(y1) AS maxy FROM cell GROUP BY split")
def mask_union(spark, sf_dir):
    parts = spatial.disjoint_boxes(masks(spark, sf_dir))
    return parts.groupBy("split").agg(F.round(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))), 6).alias("area"), F.min("x0").alias("minx"), F.min("y0").alias("miny"), F.max("x1").alias("maxx"), F.max("y1").alias("maxy"))


@query("jn1_valid_area", f"WITH {_AREAS} SELECT path, split, round(sum({_SHARED}), 6) AS area FROM ext JOIN cell ON {_TOUCH} GROUP BY ALL HAVING sum({_SHARED}) > 0")
def valid_area(spark, sf_dir):
    return _rounded(spatial.valid_area(headers(spark, sf_dir), spatial.disjoint_boxes(masks(spark, sf_dir))).where("area > 0"), "area")


@query("jn10_mask_bounds", f"WITH {_AREAS} SELECT path, min(greatest(minx, x0)) AS bx0, min(greatest(miny, y0)) AS by0, max(least(maxx, x1)) AS bx1, max(least(maxy, y1)) AS by1 FROM ext JOIN box ON {_TOUCH} GROUP BY path")
def bounds(spark, sf_dir):
    return spatial.mask_bounds(masks(spark, sf_dir), headers(spark, sf_dir))


_PATCH = f"""{_HEAD}, {_MASK}, p AS (SELECT path, gt, width, height, unnest(range(0, width - 63, 48)) AS px FROM head WHERE height >= 64), q AS (SELECT *, unnest(range(0, height - 63, 48)) AS py FROM p),
pb AS (SELECT path, CAST(px AS INT) AS x_offset, CAST(py AS INT) AS y_offset, {_box('px', 'py', '64', '64')} FROM q),
over AS (SELECT path, split, x_offset, y_offset, sum({_SHARED} / ((maxx - minx) * (maxy - miny))) AS overlap_ratio FROM pb JOIN cell ON {_TOUCH} GROUP BY ALL)"""


@query("fl1_overlap_ratio", f"WITH {_PATCH} SELECT path, split, x_offset, y_offset, round(overlap_ratio, 9) AS overlap_ratio FROM over WHERE overlap_ratio >= 0.5")
def overlap_ratio(spark, sf_dir):
    p = spatial.patches(headers(spark, sf_dir), spatial.settled(spatial.disjoint_boxes(masks(spark, sf_dir))), 64, 48, 0.5)
    return p.select("path", "split", "x_offset", "y_offset", F.round("overlap_ratio", 9).alias("overlap_ratio"))


@query("ag9_split_counts", f"WITH {_PATCH} SELECT split, count(*) AS patches FROM over WHERE overlap_ratio >= 0.5 GROUP BY split")
def split_counts(spark, sf_dir):
    return dataset.split_counts(spatial.patches(headers(spark, sf_dir), spatial.settled(spatial.disjoint_boxes(masks(spark, sf_dir))), 64, 48, 0.5))


@query("fl3_raster_semi_join", f"WITH {_AREAS} SELECT DISTINCT path FROM ext WHERE EXISTS (SELECT 1 FROM box WHERE {_TOUCH})")
def raster_semi_join(spark, sf_dir):
    h = spatial.with_extent(headers(spark, sf_dir))
    return h.join(spatial.meeting(h, masks(spark, sf_dir)).select("path").distinct(), "path", "left_semi").select("path")


# the ring is two rectangles, so its part in a box is known without clipping
@query("jn1_ring_clip", f"WITH {_HEAD}, ext AS (SELECT path, {_box('0', '0', 'width', 'height')} FROM head), two(x0, y0, x1, y1) AS (VALUES (500100, 3999300, 502900, 3999700), (500100, 3999700, 501500, 4000000)) SELECT path, round(sum({_SHARED}), 6) AS area FROM ext, two GROUP BY path")
def ring_clip(spark, sf_dir):
    ring = F.array(*[F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y")) for x, y in ((500100, 3999300), (502900, 3999300), (502900, 3999700), (501500, 3999700), (501500, 4000000), (500100, 4000000))])
    pairs = spatial.with_extent(headers(spark, sf_dir)).select("path", ring.alias("ring"), "minx", "miny", "maxx", "maxy")
    return spatial.clipped_area(pairs).select("path", F.round("area", 6).alias("area"))


# --- NoData -----------------------------------------------------------------------------------------------

_ND = "abs(v) <= 1e-8"


@query("fl4_nodata_mask", f"WITH {_SPARSE} SELECT path, y, x, {_ND} AS nd FROM sparse")
def nodata_mask(spark, sf_dir):
    return sparse(spark, sf_dir).select("path", "y", "x", C.is_nodata(F.col("v"), F.lit(0.0)).alias("nd"))


_WIN = "win AS (SELECT path, a * 12 AS x_offset, b * 12 AS y_offset FROM (SELECT DISTINCT event_type AS path FROM events), range(5) p(a), range(5) q(b))"


def _windows(spark, sf_dir):
    w = sparse(spark, sf_dir).select("path", F.lit(64).alias("width"), F.lit(64).alias("height")).distinct()
    return tiling.complete_windows(w, 16, 12).select("path", "x_offset", "y_offset", F.lit(16).alias("width"), F.lit(16).alias("height"))


@query("ag1_nodata_ratio", f"WITH {_SPARSE}, {_WIN} SELECT win.path, CAST(x_offset AS INT) AS x_offset, CAST(y_offset AS INT) AS y_offset, round(coalesce(avg(CASE WHEN {_ND} THEN 1.0 WHEN v IS NOT NULL THEN 0.0 END), 0), 6) AS nodata_ratio FROM win LEFT JOIN sparse s ON win.path = s.path AND y BETWEEN y_offset AND y_offset + 15 AND x BETWEEN x_offset AND x_offset + 15 GROUP BY ALL")
def nodata_ratio(spark, sf_dir):
    out = spatial.nodata_share(_windows(spark, sf_dir), sparse(spark, sf_dir), F.lit(0.0), block=16)
    return _rounded(out.select("path", "x_offset", "y_offset", "nodata_ratio"), "nodata_ratio")


@query("jn3_nodata_by_overview", f"""WITH {_SPARSE}, {_WIN}, ov AS (SELECT path, y // 8 AS oy, x // 8 AS ox, round_even(avg(v), 0) AS v FROM sparse GROUP BY ALL)
SELECT win.path, CAST(x_offset AS INT) AS x_offset, CAST(y_offset AS INT) AS y_offset, round(coalesce(avg(CASE WHEN {_ND} THEN 1.0 WHEN v IS NOT NULL THEN 0.0 END), 0), 6) AS nodata_ratio
FROM win LEFT JOIN ov ON win.path = ov.path AND oy BETWEEN y_offset // 8 AND y_offset // 8 + 1 AND ox BETWEEN x_offset // 8 AND x_offset // 8 + 1 GROUP BY ALL""")
def nodata_by_overview(spark, sf_dir):
    s = sparse(spark, sf_dir)
    cells = s.groupBy("path", F.expr("y div 8").cast("int").alias("oy"), F.expr("x div 8").cast("int").alias("ox")).agg(F.rint(F.avg("v")).alias("v"))
    out = spatial.nodata_share_by_overview(_windows(spark, sf_dir), cells, 8, (8, 8), F.lit(0.0))
    return _rounded(out.select("path", "x_offset", "y_offset", "nodata_ratio"), "nodata_ratio")


@query("ag3_overview", f"WITH {_BYTE} SELECT c, CAST(y // 8 AS INT) AS oy, CAST(x // 8 AS INT) AS ox, round(avg(v), 6) AS v FROM bpix GROUP BY ALL")
def overview(spark, sf_dir):
    return _rounded(resample.overview(byte_scene(spark, sf_dir), 8), "v")


# --- value ranges -----------------------------------------------------------------------------------------


@query("pj6_normalize_255", f"WITH {_BYTE} SELECT c, y, x, round(v / 255 * 2 - 1, 6) AS v FROM bpix")
def normalize_255(spark, sf_dir):
    return _rounded(byte_scene(spark, sf_dir).withColumn("v", C.signed_unit(F.col("v"))), "v")


_UNIT = _PIX + ",\nend_ AS (SELECT min(v) AS lo, max(v) AS hi FROM pix WHERE c IN (1, 2)),\nunit AS (SELECT c, y, x, (v - lo) / nullif(hi - lo, 0) * 2 - 1 AS v FROM pix, end_ WHERE c IN (1, 2))"


@query("pj7_normalize_minmax", f"WITH {_UNIT} SELECT c, y, x, {_r()} FROM unit")
def normalize_minmax(spark, sf_dir):
    return _rounded(denoise.normalised(scene(spark, sf_dir), (1, 2)), "v")


@query("ag8_global_range", f"WITH {_PIX} SELECT min(v) AS lo, max(v) AS hi, count(*) AS n FROM pix")
def global_range(spark, sf_dir):
    return scene(spark, sf_dir).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))


@query("pj8_to_uint8", f"WITH {_PIX} SELECT c, y, x, CAST(round_even((greatest(-1, least(1, v * 4)) + 1) / 2 * 255, 0) AS INT) AS v FROM pix")
def to_uint8(spark, sf_dir):
    return scene(spark, sf_dir).withColumn("v", C.byte_of_signed(F.col("v") * 4))


@query("pj9_byte_clip", f"WITH {_PIX} SELECT c, y, x, CAST(round_even(greatest(0, least(255, v * 900 + 100)), 0) AS INT) AS v FROM pix")
def byte_clip(spark, sf_dir):
    return scene(spark, sf_dir).withColumn("v", C.byte_clip(F.col("v") * 900 + 100))


# --- tiling and fusion ------------------------------------------------------------------------------------


@query("wn1_patch_grid", f"WITH {_HEAD}, p AS (SELECT path, width, height, unnest(range(0, width - 127, 32)) AS x FROM head WHERE height >= 128 AND width >= 128) SELECT path, CAST(x AS INT) AS x_offset, CAST(unnest(range(0, height - 127, 32)) AS INT) AS y_offset FROM p")
def patch_grid(spark, sf_dir):
    return tiling.complete_windows(headers(spark, sf_dir), 128, 32).select("path", "x_offset", "y_offset")


@query("wn2_views", f"""WITH {_PIX}{_VIEWS} SELECT CAST(CASE WHEN h0 % {STRIDE} = 0 AND h0 // {STRIDE} < nh AND w0 % {STRIDE} = 0 AND w0 // {STRIDE} < nw THEN h0 // {STRIDE} * nw + w0 // {STRIDE}
    WHEN w0 % {STRIDE} = 0 AND w0 // {STRIDE} < nw THEN nh * nw + w0 // {STRIDE} WHEN h0 % {STRIDE} = 0 AND h0 // {STRIDE} < nh THEN nh * nw + (CASE WHEN (nh - 1) * {STRIDE} + {TILE} < h THEN nw ELSE 0 END) + h0 // {STRIDE}
    ELSE nh * nw + nw + nh END AS INT) AS tile_id, h0, w0, h0 + {TILE} AS h1, w0 + {TILE} AS w1 FROM tile, grid""")
def views(spark, sf_dir):
    return tiling.views(spark, *shape(spark, sf_dir), TILE, STRIDE)


@query("wn5_chunks", f"WITH {_PIX} SELECT CAST(y // 48 AS INT) AS by, CAST(x // 48 AS INT) AS bx, count(*) AS n FROM pix WHERE c = 1 GROUP BY ALL")
def chunks(spark, sf_dir):
    return tiling.chunked(scene(spark, sf_dir).where("c = 1"), 48).groupBy("by", "bx").agg(F.count("*").alias("n"))


@query("wn6_slabs", f"WITH {_PIX} SELECT CAST(y // 100 AS INT) AS slab, count(*) AS n FROM pix GROUP BY ALL")
def slabs(spark, sf_dir):
    return tiling.slabs(scene(spark, sf_dir), 100).groupBy("slab").agg(F.count("*").alias("n"))


@query("ag14_batches", "SELECT vec_id, CAST(vec_id // 8 AS INT) AS batch, CAST(vec_id % 8 AS INT) AS slot FROM embeddings")
def batches(spark, sf_dir):
    return tiling.batches(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id"), F.col("vec_id"), 8)


@query("pj11_guidance", f"SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, round({_RADIAL}, 9) AS w FROM range({TILE}) a(i), range({TILE}) b(j)")
def guidance(spark, sf_dir):
    return tiling.guidance(spark, TILE).withColumn("w", F.round("w", 9))


@query("ag4_geometry_maps", f"WITH {_PIX}{_COVER} SELECT y, x, round(sum(wt), 6) AS wsum, round(sum(wt * wt), 6) AS w2sum FROM cov WHERE c = 1 GROUP BY y, x")
def geometry_maps(spark, sf_dir):
    s = scene(spark, sf_dir).where("c = 1")
    return _rounded(fusion.geometry_maps(tiling.covered(s, *shape(spark, sf_dir), TILE, STRIDE)), "wsum", "w2sum")


_N = _normal(["c", "y", "x", "h0 * 131 + w0"], SEED)
_PARTS = _PIX + _COVER + f",\npart AS (SELECT c, y, x, wt, v AS mu, {_N} * 0.1 AS n FROM cov)"


def _parts(spark, sf_dir):
    s = tiling.covered(scene(spark, sf_dir), *shape(spark, sf_dir), TILE, STRIDE)
    z = C.gaussian(F.col("c"), F.col("y"), F.col("x"), C.place_key(F.col("h0"), F.col("w0"), 131), seed=SEED)
    return s.select("c", "y", "x", "w", F.col("v").alias("mu"), (z * 0.1).alias("n"))


@query("ag7_fuse_avg", f"WITH {_PARTS} SELECT c, y, x, round(sum(wt * (mu + n)) / sum(wt), 6) AS v FROM part GROUP BY c, y, x")
def fuse_avg(spark, sf_dir):
    return _rounded(fusion.fuse_average(_parts(spark, sf_dir)), "v")


_GEO = ", geo AS (SELECT y, x, sum(wt) AS ws, sqrt(sum(wt * wt)) AS s FROM part WHERE c = 1 GROUP BY y, x)"
_SDVC = f"WITH {_PARTS}{_GEO} SELECT c, p.y, p.x, round(sum(wt / s * (mu + n) + (1 - ws / s) * wt / ws * mu), 6) AS v FROM part p JOIN geo g ON p.y = g.y AND p.x = g.x GROUP BY c, p.y, p.x"


@query("ag6_fuse_sdvc", _SDVC)
def fuse_sdvc(spark, sf_dir):
    return _rounded(fusion.fuse_variance_preserving(_parts(spark, sf_dir)), "v")


@query("ag6_fuse_sdvc_joined", f"WITH {_PARTS} SELECT c, y, x, round(sum(wt * mu) / sum(wt) + sum(wt * n) / sqrt(sum(wt * wt)), 6) AS v FROM part GROUP BY c, y, x")
def fuse_sdvc_joined(spark, sf_dir):
    p = _parts(spark, sf_dir)
    return _rounded(fusion.fuse_with_maps(p, fusion.geometry_maps(p.where("c = 1"))), "v")


# --- resampling -------------------------------------------------------------------------------------------

_DOWN = ",\n" + ",\n".join([_area("ax", "w", f"greatest(1, w // {LOW})"), _area("ay", "h", f"greatest(1, h // {LOW})")])
_UP = ",\n" + ",\n".join([_cubic("ux", f"greatest(1, w // {LOW})", "w"), _cubic("uy", f"greatest(1, h // {LOW})", "h")])


@query("rs1_down_area", f"WITH {_PIX}{_DOWN},\n{_two('down', 'pix', 'ax', 'ay')} SELECT c, y, x, {_r()} FROM down")
def down_area(spark, sf_dir):
    h, w = shape(spark, sf_dir)
    return _rounded(resample.down_area(scene(spark, sf_dir), (h, w), (low(h), low(w))), "v")


@query("rs2_up_cubic", f"WITH {_PIX},\n{_cubic('ux', 'w', 'w * 2')},\n{_cubic('uy', 'h', 'h * 2')},\none AS (SELECT * FROM pix WHERE c = 1),\n{_two('up', 'one', 'ux', 'uy')} SELECT c, y, x, {_r()} FROM up")
def up_cubic(spark, sf_dir):
    h, w = shape(spark, sf_dir)
    return _rounded(resample.up_cubic(scene(spark, sf_dir).where("c = 1"), (h, w), (2 * h, 2 * w)), "v")


@query("rs3_degrade", f"WITH {_PIX}{_DOWN}{_UP},\n{_two('down', 'pix', 'ax', 'ay')},\n{_two('up', 'down', 'ux', 'uy')} SELECT c, y, x, {_r()} FROM up")
def degraded(spark, sf_dir):
    h, w = shape(spark, sf_dir)
    return _rounded(resample.degrade(scene(spark, sf_dir), (h, w), (low(h), low(w))), "v")


@query("rs5_lf_projection", f"""WITH {_PIX}{_DOWN}{_UP}, a AS (SELECT 1 AS c, y, x, v * 400 + 120 AS v FROM pix WHERE c = 1), b AS (SELECT 1 AS c, y, x, v * 300 + 90 AS v FROM pix WHERE c = 2),
{_two('da', 'a', 'ax', 'ay')},\n{_two('db', 'b', 'ax', 'ay')},\ngap AS (SELECT da.c, da.y, da.x, db.v - da.v AS v FROM da JOIN db ON da.y = db.y AND da.x = db.x),
{_two('up', 'gap', 'ux', 'uy')} SELECT a.c, a.y, a.x, round(greatest(0, least(255, a.v + up.v)), 6) AS v FROM a JOIN up ON a.y = up.y AND a.x = up.x""")
def lf_projection(spark, sf_dir):
    s = scene(spark, sf_dir)
    a = s.where("c = 1").withColumn("v", F.col("v") * 400 + 120)
    b = s.where("c = 2").select(F.lit(1).alias("c"), "y", "x", (F.col("v") * 300 + 90).alias("v"))
    return _rounded(resample.low_frequency_projection(a, b, shape(spark, sf_dir), LOW), "v")


@query("rs4_preview", f"WITH {_PIX}, s AS (SELECT h, w, greatest(1.0, greatest(h, w) / 100.0) AS f FROM dim), o AS (SELECT h, w, CAST(greatest(1, round_even(h / f, 0)) AS INT) AS mh, CAST(greatest(1, round_even(w / f, 0)) AS INT) AS mw FROM s), oy AS (SELECT unnest(range(mh)) AS dy, h, mh FROM o), ox AS (SELECT unnest(range(mw)) AS dx, w, mw FROM o) SELECT c, CAST(dy AS INT) AS y, CAST(dx AS INT) AS x, {_r()} FROM pix JOIN oy ON y = floor((dy + 0.5) * h / mh) JOIN ox ON x = floor((dx + 0.5) * w / mw)")
def preview(spark, sf_dir):
    return _rounded(resample.decimate(scene(spark, sf_dir), shape(spark, sf_dir), 100), "v")


@query("jn7_common_extent", f"WITH {_PIX} SELECT a.y, a.x, round(a.v - b.v, 6) AS gap FROM pix a JOIN pix b ON a.y = b.y AND a.x = b.x WHERE a.c = 1 AND b.c = 2 AND a.y < 300 AND b.x < 50")
def common_extent(spark, sf_dir):
    s = scene(spark, sf_dir)
    a, b = s.where("c = 1 and y < 300").select("y", "x", "v"), s.where("c = 2 and x < 50").select("y", "x", F.col("v").alias("o"))
    return a.join(b, ["y", "x"]).select("y", "x", F.round(F.col("v") - F.col("o"), 6).alias("gap"))


def _fractal(name: str, bands: int, seed: int, size: int = 64, octaves: int = 4) -> str:
    """SQL of keyed noise on grids of 4, 8, 16 ... cells, resized, halved in strength, summed and brought to 0..1."""
    parts = []
    for k in range(octaves):
        n = 1 << (k + 2)
        parts.append(f"{name}w{k} AS (WITH {_cubic('t', str(n), str(size))} SELECT * FROM t)")
        parts.append(f"{name}g{k} AS (SELECT c, y, x, {_noise(['c', 'y', 'x'], seed + k)} * {0.5**k} AS v FROM range(1, {bands + 1}) a(c), range({n}) b(y), range({n}) d(x))")
        parts.append(_two(f"{name}u{k}", f"{name}g{k}", f"{name}w{k}", f"{name}w{k}"))
    total = " UNION ALL ".join(f"SELECT * FROM {name}u{k}" for k in range(octaves))
    return ",\n".join(parts) + f",\n{name}s AS (SELECT c, y, x, sum(v) AS v FROM ({total}) GROUP BY c, y, x),\n{name} AS (SELECT c, y, x, (v - min(v) OVER (PARTITION BY c)) / (max(v) OVER (PARTITION BY c) - min(v) OVER (PARTITION BY c)) AS v FROM {name}s)"


_SYNTHETIC = f"WITH dim AS (SELECT 1 AS one), {_fractal('shape', 1, 0)},\n{_fractal('own', 3, 100)}"


@query("sc17_synthetic_scene", f"{_SYNTHETIC} SELECT CAST(own.c AS INT) AS c, own.y, own.x, round_even(least(greatest((0.75 * shape.v + 0.25 * own.v) * [1.00, 0.92, 0.78][own.c] * 255, 20.0), 235.0), 0) AS v FROM own JOIN shape ON own.y = shape.y AND own.x = shape.x")
def synthetic(spark, sf_dir):
    return resample.synthetic_scene(spark, 64, octaves=4)


# --- diffusion --------------------------------------------------------------------------------------------


@query("df1_schedule", f"WITH {_SCHEDULE} SELECT t, round(beta, 12) AS beta, round(acp, 9) AS acp, round(acp_prev, 9) AS acp_prev, round(post_var, 9) AS post_var, round(post_logvar, 6) AS post_logvar, round(coef1, 9) AS coef1, round(coef2, 9) AS coef2, round(sqrt_recip, 6) AS sqrt_recip FROM step")
def noise_schedule(spark, sf_dir):
    digits = {"beta": 12, "acp": 9, "acp_prev": 9, "post_var": 9, "post_logvar": 6, "coef1": 9, "coef2": 9, "sqrt_recip": 6}
    return D.schedule(spark, STEPS).select("t", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query("fl6_remaining_steps", f"SELECT CAST(t AS INT) AS t, t % 200 = 0 AS saves FROM range({STEPS}) r(t) WHERE t < 1234")
def remaining_steps(spark, sf_dir):
    return D.schedule(spark, STEPS).where("t < 1234").select("t", (F.col("t") % 200 == 0).alias("saves"))


_T = "(y * 7 + x) % 2000"
_E = _normal(["c", "y", "x"], 3)
_AT = f"at_ AS (SELECT c, y, x, CAST({_T} AS INT) AS t, v, {_E} AS e FROM unit)"


def _at(spark, sf_dir):
    u = denoise.normalised(scene(spark, sf_dir), (1, 2))
    return u.select("c", "y", "x", F.expr("(y * 7 + x) % 2000").alias("t"), "v", C.gaussian(F.col("c"), F.col("y"), F.col("x"), seed=3).alias("e"))


@query("df2_q_sample", f"WITH {_UNIT}, {_SCHEDULE}, {_AT} SELECT c, y, x, round(sqrt(acp) * v + sqrt(1 - acp) * e, 6) AS noisy FROM at_ JOIN step ON at_.t = step.t")
def q_sample(spark, sf_dir):
    s = D.schedule(spark, STEPS).select("t", "acp")
    return _at(spark, sf_dir).join(F.broadcast(s), "t").select("c", "y", "x", F.round(D.noised(F.col("v"), D.level(F.col("acp")), F.col("e")), 6).alias("noisy"))


@query("df3_x0_from_noise", f"WITH {_UNIT}, {_SCHEDULE}, {_AT} SELECT c, y, x, round(sqrt_recip * v - sqrt_recipm1 * e, 4) AS x0 FROM at_ JOIN step ON at_.t = step.t")
def x0_from_noise(spark, sf_dir):
    s = D.schedule(spark, STEPS).alias("s")
    r = _at(spark, sf_dir).alias("r").join(F.broadcast(s), F.col("r.t") == F.col("s.t"))
    return r.select("c", "y", "x", F.round(D.start_from_noise(F.col("v"), F.col("e")), 4).alias("x0"))


@query("df4_posterior", f"WITH {_UNIT}, {_SCHEDULE}, {_AT} SELECT c, y, x, round(coef1 * v + coef2 * e, 6) AS mean, round(post_logvar, 6) AS logvar FROM at_ JOIN step ON at_.t = step.t")
def posterior(spark, sf_dir):
    s = D.schedule(spark, STEPS).alias("s")
    r = _at(spark, sf_dir).alias("r").join(F.broadcast(s), F.col("r.t") == F.col("s.t"))
    return r.select("c", "y", "x", F.round(D.posterior_mean(F.col("v"), F.col("e")), 6).alias("mean"), F.round("s.post_logvar", 6).alias("logvar"))


_CLAMP = "greatest(-1, least(1, {}))"
_REV = _CLAMP.format("sqrt_recip * e - sqrt_recipm1 * ((e - sqrt(acp) * v) / sqrt(1 - acp))")


@query("df7_reverse_step", f"WITH {_UNIT}, {_SCHEDULE}, {_AT} SELECT c, y, x, round(coef1 * {_REV} + coef2 * e, 6) AS mu, round(CASE WHEN at_.t = 0 THEN 0 ELSE v * exp(post_logvar / 2) END, 6) AS n FROM at_ JOIN step ON at_.t = step.t")
def reverse(spark, sf_dir):
    rows = _at(spark, sf_dir).select("c", "y", F.col("x").alias("gx"), "t", F.col("e").alias("x"), "v")
    out = D.reverse_step(rows, D.schedule(spark, STEPS), D.oracle_noise(F.col("r.v"), F.col("r.x")), F.col("r.v"))
    return out.select("c", "y", F.col("gx").alias("x"), F.round("mu", 6).alias("mu"), F.round("n", 6).alias("n"))


def _chain(t_first: int, count: int, seed: int) -> str:
    """SQL of the joint chain from step t_first down, count steps long, on the bands 1 and 2."""
    sql = f"{_UNIT}{_VIEWS}, {_SCHEDULE}, state0 AS (SELECT c, y, x, v AS cond, {_normal(['c', 'y', 'x'], seed)} AS s FROM unit)"
    for k in range(count):
        t = t_first - k
        z = _normal(["c", "y", "x", "h0 * 65537 + w0"], seed + 7919 * (t + 1))
        x0 = _CLAMP.format("sqrt_recip * s - sqrt_recipm1 * ((s - sqrt(acp) * cond) / sqrt(1 - acp))")
        noise = "0" if t == 0 else f"{z} * exp(post_logvar / 2)"
        sql += f""",
part{k} AS (SELECT c, y, x, cond, {_RADIAL} AS wt, coef1 * {x0} + coef2 * s AS mu, {noise} AS n FROM (SELECT a.*, h0, w0, y - h0 AS i, x - w0 AS j FROM state{k} a JOIN tile ON y >= h0 AND y < h0 + {TILE} AND x >= w0 AND x < w0 + {TILE}), step WHERE step.t = {t}),
state{k + 1} AS (SELECT c, y, x, any_value(cond) AS cond, sum(wt * mu) / sum(wt) + sum(wt * n) / sqrt(sum(wt * wt)) AS s FROM part{k} GROUP BY c, y, x)"""
    return sql


_INFER = InferConfig(patch_size=TILE, stride=STRIDE, bands=(1, 2), seed=5, steps=STEPS)


def _joint(spark, sf_dir, t_first: int, count: int) -> DataFrame:
    s = denoise.normalised(scene(spark, sf_dir), _INFER.bands)
    steps, dims, now = D.schedule(spark, STEPS), shape(spark, sf_dir), D.initial_state(s, _INFER.seed, carry=True)
    for t in range(t_first, t_first - count, -1):
        now = denoise.joint_step(now, None, steps, t, dims, _INFER)
    return _rounded(now.drop("cond"), "v")


@query("df9_joint_step", f"WITH {_chain(1999, 1, 5)} SELECT c, y, x, round(s, 6) AS v FROM state1")
def joint_step(spark, sf_dir):
    return _joint(spark, sf_dir, 1999, 1)


@query("df10_joint_chain", f"WITH {_chain(2, 3, 5)} SELECT c, y, x, round(s, 6) AS v FROM state3")
def joint_chain(spark, sf_dir):
    return _joint(spark, sf_dir, 2, 3)


@query("df11_initial_state", f"WITH {_PIX} SELECT c, y, x, round({_normal(['c', 'y', 'x'], 9)}, 6) AS v FROM pix")
def first_state(spark, sf_dir):
    return _rounded(D.initial_state(scene(spark, sf_dir), 9), "v")


_TRAIN = f"""tr AS (SELECT y AS sample, c, x, v, y // 8 AS batch, CAST(floor({_noise(['y // 8'], 1)} * {STEPS}) + 1 AS INT) AS t FROM unit),
lv AS (SELECT tr.*, sqrt(acp_prev) + {_noise(['sample', 'batch'], 2)} * (sqrt(acp) - sqrt(acp_prev)) AS level FROM tr JOIN sch ON sch.t + 1 = tr.t),
ns AS (SELECT *, {_normal(['sample', 'c', 'x'], 3)} AS e FROM lv), nz AS (SELECT *, level * v + sqrt(1 - level * level) * e AS noisy FROM ns)"""


@query("df12_training_loss", f"WITH {_UNIT}, {_SCHEDULE}, {_TRAIN} SELECT t, count(*) AS n, round(avg(abs(e - noisy)), 6) AS loss FROM nz GROUP BY t")
def training_loss(spark, sf_dir):
    u = denoise.normalised(scene(spark, sf_dir), (1, 2)).select(F.col("y").alias("sample"), "c", "x", "v")
    rows = D.training_pairs(u, D.schedule(spark, STEPS), F.expr("sample div 8"), seed=1)
    return rows.groupBy("t").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("noise") - F.col("noisy"))), 6).alias("loss"))


@query("ag10_l1_loss", f"WITH {_PIX} SELECT round(avg(abs(a.v - b.v)), 9) AS loss FROM pix a JOIN pix b ON a.y = b.y AND a.x = b.x AND a.c = 1 AND b.c = 3")
def l1_loss(spark, sf_dir):
    s = scene(spark, sf_dir)
    pairs = s.where("c = 1").select("y", "x", F.col("v").alias("a")).join(s.where("c = 3").select("y", "x", F.col("v").alias("b")), ["y", "x"])
    return D.mean_absolute_error(pairs, "a", "b").select(F.round("loss", 9).alias("loss"))


@query("pj16_comparison_grid", f"""WITH {_PIX}, im AS (SELECT a.y // 16 AS sample, a.y % 16 AS i, a.x AS j, a.v AS lr, b.v AS made, d.v AS hr FROM pix a JOIN pix b ON a.y = b.y AND a.x = b.x AND b.c = 2 JOIN pix d ON a.y = d.y AND a.x = d.x AND d.c = 3 WHERE a.c = 1 AND a.x < 16 AND a.y < 128),
cs AS (SELECT sample, i, j, unnest([0, 1, 2]) AS col, unnest([lr, made, hr]) AS u FROM im) SELECT 1 AS c, CAST(sample * 18 + 2 + i AS INT) AS y, CAST(col * 18 + 2 + j AS INT) AS x, round((greatest(-1, least(1, u)) + 1) / 2, 6) AS v FROM cs""")
def comparison_grid(spark, sf_dir):
    s = scene(spark, sf_dir).where("x < 16")
    parts = [s.where(f"c = {c}").select("y", F.col("x").alias("j"), F.col("v").alias(n)) for c, n in ((1, "lr"), (2, "made"), (3, "hr"))]
    im = parts[0].join(parts[1], ["y", "j"]).join(parts[2], ["y", "j"])
    im = im.select(F.expr("cast(y div 16 as int)").alias("sample"), F.lit(1).alias("c"), F.expr("y % 16").alias("i"), "j", "lr", "made", "hr")
    return _rounded(dataset.comparison_grid(im, 16), "v")


@query("nn10_unet_forward")
def unet_forward(spark, sf_dir):
    """A narrow network on every tile of one band at one step, as contributions fused into a state."""
    from gridloom.operators import unet

    kind = unet.Shape(bands=1, base=4, multipliers=(1, 2), groups=2)
    weights = unet.initial_weights(kind)
    s = denoise.normalised(scene(spark, sf_dir), (1,))
    tiles = denoise.tile_rows(D.initial_state(s, 1), s, shape(spark, sf_dir), TILE, STRIDE)
    row = D.schedule(spark, STEPS).where("t = 1000").first().asDict()
    parts = denoise.tile_step(tiles, row, lambda cond, x, level: unet.predict(weights, kind, cond, x, level), [1], TILE)
    return _rounded(fusion.fuse_variance_preserving(parts), "v")


@query("flagship_fused_bytes", f"WITH {_PARTS}{_GEO} SELECT c, p.y, p.x, CAST(round_even((greatest(-1, least(1, sum(wt / s * (mu + n) + (1 - ws / s) * wt / ws * mu))) + 1) / 2 * 255, 0) AS INT) AS v FROM part p JOIN geo g ON p.y = g.y AND p.x = g.x GROUP BY c, p.y, p.x")
def flagship(spark, sf_dir):
    """Tiles, weights, variance-preserving fusion and bytes in one plan without a join or a Python worker."""
    return denoise.as_bytes(fusion.fuse_variance_preserving(_parts(spark, sf_dir)))


# queries of files and of the network's parts, which use those above
from gridloom.plans import file_queries, kernel_queries  # noqa: E402, F401
