"""The parts of the noise predictor on small images, each against SQL in which a convolution is a join and attention a softmax over positions.

An image is eight rows of `embeddings` (sample = vec_id div 8, y = vec_id mod 8) in two channels of eight
columns each. Weights are fixed rules of their indices, so that both sides have them without a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import unet
from gridloom.plans.queries import _rounded, query

SIDE, GROUPS, EMBEDDING = 8, 2, (-0.5, -0.25, 0.0, 0.25)
_IMG = f"""raw AS (SELECT CAST(vec_id // {SIDE} AS INT) AS sample, CAST(c AS INT) AS c, CAST(vec_id % {SIDE} AS INT) AS y, CAST(x AS INT) AS x, CAST(embedding[c * {SIDE} + x + 1] AS DOUBLE) AS v FROM embeddings, range(2) a(c), range({SIDE}) b(x)),
img AS (SELECT * FROM raw WHERE sample IN (SELECT sample FROM raw GROUP BY sample HAVING count(*) = {2 * SIDE * SIDE}))"""
_OUT = "SELECT sample, c, y, x, round(v, 6) AS v FROM {}"


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, cells: the values of an image by channel, row and column; an image lacking rows is left out."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.expr(f"cast(vec_id div {SIDE} as int)").alias("sample"), F.expr(f"cast(vec_id % {SIDE} as int)").alias("y"), F.posexplode(F.slice("embedding", 1, 2 * SIDE)).alias("k", "e"))
    cells = F.array_sort(F.collect_list(F.struct(F.expr(f"k div {SIDE}").alias("c"), "y", F.expr(f"k % {SIDE}").alias("x"), F.col("e").cast("double").alias("v"))))
    return e.groupBy("sample").agg(cells.alias("cells")).where(F.size("cells") == 2 * SIDE * SIDE).select("sample", F.col("cells.v").alias("cells"))


def mapped(spark: SparkSession, sf_dir: str, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Pixels (sample, c, y, x, v) of what a kernel makes of each image."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for sample, cells in zip(pdf["sample"], pdf["cells"], strict=True):
                made = kernel(np.asarray(cells, float).reshape(2, SIDE, SIDE))
                c, y, x = (v.ravel().astype(np.int32) for v in np.indices(made.shape))
                yield pd.DataFrame({"sample": np.int32(sample), "c": c, "y": y, "x": x, "v": made.ravel()})

    return _rounded(images(spark, sf_dir).mapInPandas(rows, "sample int, c int, y int, x int, v double"), "v")


# --- weights by rule --------------------------------------------------------------------------------------


def conv_weights(out: int, into: int, k: int = 3, at: int = 0) -> tuple[np.ndarray, np.ndarray]:
    o, i, a, b = np.indices((out, into, k, k))
    return ((o * 7 + i * 5 + a * 3 + b + at) % 11 - 5) / 10, (np.arange(out) % 3 - 1) / 10


def norm_weights(n: int) -> tuple[np.ndarray, np.ndarray]:
    return 1 + np.arange(n) / 10, np.arange(n) / 20


def level_weights(out: int) -> tuple[np.ndarray, np.ndarray]:
    o, j = np.indices((out, len(EMBEDDING)))
    return ((o * 3 + j) % 7 - 3) / 10, np.arange(out) % 2 / 10


def attention_weights(n: int, name: str) -> dict[str, np.ndarray]:
    o, i = np.indices((3 * n, n))
    scale, shift = norm_weights(n)
    return {f"{name}.scale": scale, f"{name}.shift": shift, f"{name}.qkv": ((o * 5 + i * 3) % 7 - 3) / 5, f"{name}.out": ((o[:n] * 2 + i[:n]) % 5 - 2) / 5, f"{name}.bias": (np.arange(n) % 3 - 1) / 10}


def block_weights(into: int, out: int, name: str) -> dict[str, np.ndarray]:
    p = {}
    for k, (a, b) in enumerate(((into, out), (out, out)), 1):
        p[f"{name}.n{k}.scale"], p[f"{name}.n{k}.shift"] = norm_weights(a)
        p[f"{name}.c{k}.w"], p[f"{name}.c{k}.b"] = conv_weights(b, a, at=k)
    p[f"{name}.level"], p[f"{name}.level0"] = level_weights(out)
    if into != out:
        p[f"{name}.skip.w"], p[f"{name}.skip.b"] = conv_weights(out, into, 1, at=4)
    return p


# --- the same in SQL --------------------------------------------------------------------------------------


def _conv(name: str, source: str, out: int, into: int, stride: int = 1, k: int = 3, at: int = 0, side: int = SIDE) -> str:
    """A pixel goes to every place whose kernel covers it; what the border lacks adds nothing."""
    to, reach = side // stride, k // 2
    y, x = f"(s.y - a + {reach})", f"(s.x - b + {reach})"
    inside = " AND ".join(f"{p} % {stride} = 0 AND {p} >= 0 AND {p} < {side}" for p in (y, x))
    return f"""{name} AS (SELECT sample, CAST(o AS INT) AS c, CAST({y} // {stride} AS INT) AS y, CAST({x} // {stride} AS INT) AS x, sum(v * ((o * 7 + s.c * 5 + a * 3 + b + {at}) % 11 - 5) / 10) + (o % 3 - 1) / 10 AS v
    FROM {source} s, range({out}) p(o), range({k}) q(a), range({k}) r(b) WHERE {inside} AND {to} > 0 GROUP BY sample, o, {y} // {stride}, {x} // {stride})"""


def _norm(name: str, source: str, channels: int, groups: int = GROUPS) -> str:
    own = f"(c // {channels // min(groups, channels)})"
    return f"{name} AS (SELECT sample, c, y, x, (v - avg(v) OVER g) / sqrt(var_pop(v) OVER g + 1e-5) * (1 + c / 10) + c / 20 AS v FROM {source} WINDOW g AS (PARTITION BY sample, {own}))"


def _swish(name: str, source: str) -> str:
    return f"{name} AS (SELECT sample, c, y, x, v / (1 + exp(-v)) AS v FROM {source})"


def _level(name: str, source: str) -> str:
    term = " + ".join(f"{e} * (((c * 3 + {j}) % 7 - 3) / 10)" for j, e in enumerate(EMBEDDING))
    return f"{name} AS (SELECT sample, c, y, x, v + {term} + (c % 2) / 10 AS v FROM {source})"


def _stage(name: str, source: str, out: int, into: int, at: int = 0) -> str:
    return ",\n".join([_norm(f"{name}_n", source, into), _swish(f"{name}_s", f"{name}_n"), _conv(name, f"{name}_s", out, into, at=at)])


def _block(name: str, source: str, out: int, into: int) -> str:
    parts = [_stage(f"{name}_1", source, out, into, 1), _level(f"{name}_l", f"{name}_1"), _stage(f"{name}_2", f"{name}_l", out, out, 2)]
    skip = source
    if into != out:
        skip = f"{name}_k"
        parts.append(_conv(skip, source, out, into, k=1, at=4))
    return ",\n".join([*parts, f"{name} AS (SELECT h.sample, h.c, h.y, h.x, h.v + s.v AS v FROM {name}_2 h JOIN {skip} s ON h.sample = s.sample AND h.c = s.c AND h.y = s.y AND h.x = s.x)"])


def _attend(name: str, source: str, n: int) -> str:
    """Positions are y * SIDE + x; queries, keys and values are the thirds of one linear map."""
    return f"""{_norm(f"{name}_n", source, n)},
{name}_m AS (SELECT sample, CAST(o AS INT) AS o, y * {SIDE} + x AS pos, sum(v * (((o * 5 + c * 3) % 7 - 3) / 5)) AS v FROM {name}_n, range({3 * n}) p(o) GROUP BY sample, o, y, x),
{name}_d AS (SELECT q.sample, q.pos, k.pos AS other, exp(sum(q.v * k.v) / sqrt({n}.0)) AS e FROM {name}_m q JOIN {name}_m k ON q.sample = k.sample AND k.o = q.o + {n} WHERE q.o < {n} GROUP BY ALL),
{name}_a AS (SELECT sample, pos, other, e / sum(e) OVER (PARTITION BY sample, pos) AS a FROM {name}_d),
{name}_v AS (SELECT d.sample, d.pos, m.o - {2 * n} AS c, sum(a * m.v) AS v FROM {name}_a d JOIN {name}_m m ON d.sample = m.sample AND d.other = m.pos AND m.o >= {2 * n} GROUP BY ALL),
{name}_o AS (SELECT sample, pos, CAST(o AS INT) AS c, sum(v * ((o * 2 + c) % 5 - 2) / 5) + (o % 3 - 1) / 10 AS v FROM {name}_v, range({n}) p(o) GROUP BY sample, pos, o),
{name} AS (SELECT s.sample, s.c, s.y, s.x, s.v + o.v AS v FROM {source} s JOIN {name}_o o ON s.sample = o.sample AND s.c = o.c AND s.y * {SIDE} + s.x = o.pos)"""


# --- queries ----------------------------------------------------------------------------------------------


@query("nn1_level_encoding", "SELECT vec_id, CAST(k AS INT) AS k, round(CASE WHEN k < 4 THEN sin(l * exp(-ln(1e4) * k / 4)) ELSE cos(l * exp(-ln(1e4) * (k - 4) / 4)) END, 6) AS v FROM (SELECT vec_id, (vec_id + 1) / 1000.0 AS l FROM embeddings), range(8) p(k)")
def level_encoding(spark, sf_dir):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = np.array([unet.encode_level((i + 1) / 1000, 8) for i in pdf["vec_id"].tolist()]).reshape(-1, 8)
            yield pd.DataFrame({"vec_id": np.repeat(pdf["vec_id"].to_numpy(), 8), "k": np.tile(np.arange(8, dtype=np.int32), len(made)), "v": made.ravel()})

    return _rounded(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id").mapInPandas(rows, "vec_id long, k int, v double"), "v")


@query("nn2_level_affine", f"WITH {_IMG}, {_level('out_', 'img')} {_OUT.format('out_')}")
def level_affine(spark, sf_dir):
    w, b = level_weights(2)
    return mapped(spark, sf_dir, lambda x: unet.affine(x, np.array(EMBEDDING), w, b))


@query("nn3_swish", f"WITH {_IMG}, {_swish('out_', 'img')} {_OUT.format('out_')}")
def swish(spark, sf_dir):
    return mapped(spark, sf_dir, unet.swish)


@query("nn4_doubled", f"WITH {_IMG}, big AS (SELECT sample, c, y * 2 + dy AS y, x * 2 + dx AS x, v FROM img, range(2) p(dy), range(2) q(dx)), {_conv('out_', 'big', 3, 2, side=2 * SIDE)} {_OUT.format('out_')}")
def doubled(spark, sf_dir):
    w, b = conv_weights(3, 2)
    return mapped(spark, sf_dir, lambda x: unet.doubled(x, w, b))


@query("nn5_halved", f"WITH {_IMG}, {_conv('out_', 'img', 3, 2, stride=2)} {_OUT.format('out_')}")
def halved(spark, sf_dir):
    w, b = conv_weights(3, 2)
    return mapped(spark, sf_dir, lambda x: unet.halved(x, w, b))


@query("nn6_stage", f"WITH {_IMG}, {_stage('out_', 'img', 4, 2)} {_OUT.format('out_')}")
def stage(spark, sf_dir):
    p = dict(zip(("n.scale", "n.shift", "c.w", "c.b"), (*norm_weights(2), *conv_weights(4, 2)), strict=True))
    return mapped(spark, sf_dir, lambda x: unet.stage(x, p, "n", "c", GROUPS))


@query("nn7_residual", f"WITH {_IMG}, {_block('out_', 'img', 4, 2)} {_OUT.format('out_')}")
def residual(spark, sf_dir):
    p = block_weights(2, 4, "b")
    return mapped(spark, sf_dir, lambda x: unet.residual(x, p, "b", np.array(EMBEDDING), GROUPS))


@query("nn8_attention", f"WITH {_IMG}, {_attend('out_', 'img', 2)} {_OUT.format('out_')}")
def attention(spark, sf_dir):
    p = attention_weights(2, "a")
    return mapped(spark, sf_dir, lambda x: unet.attend(x, p, "a", GROUPS))


@query("nn9_block_with_attention", f"WITH {_IMG}, {_block('blk', 'img', 2, 2)}, {_attend('out_', 'blk', 2)} {_OUT.format('out_')}")
def block_with_attention(spark, sf_dir):
    p = block_weights(2, 2, "b") | attention_weights(2, "a")
    return mapped(spark, sf_dir, lambda x: unet.attend(unet.residual(x, p, "b", np.array(EMBEDDING), GROUPS), p, "a", GROUPS))


@query("jn9_skip", f"WITH {_IMG}, {_conv('a', 'img', 3, 2)}, {_swish('b', 'a')}, {_conv('d', 'b', 2, 3)}, both_ AS (SELECT * FROM d UNION ALL SELECT sample, c + 2, y, x, v FROM a), {_conv('out_', 'both_', 2, 5)} {_OUT.format('out_')}")
def skip(spark, sf_dir):
    """What an earlier layer made, put beside a later one's output channel by channel."""
    one, two, three = conv_weights(3, 2), conv_weights(2, 3), conv_weights(2, 5)

    def kernel(x: np.ndarray) -> np.ndarray:
        held = [unet.convolve(x, *one)]
        return unet.convolve(np.concatenate([unet.convolve(unet.swish(held[-1]), *two), held.pop()]), *three)

    return mapped(spark, sf_dir, kernel)
