"""Column expressions on pixels: geometry, value ranges, weights and keyed noise.

All are built-in functions, so they stay in generated code; none needs a Python worker.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Modulus and multipliers of the integer noise; small enough that no product leaves 64 bits.
NOISE_MODULUS = 2147483647
NOISE_STEP = 48271
NOISE_ROUNDS = (12345, 99991)
NOISE_KEYS = (73856093, 19349663, 83492791, 50331653)


def to_geo(px: Column, py: Column, gt: Column) -> tuple[Column, Column]:
    """Map coordinates of a pixel corner under a six-term geotransform, rotation terms included."""
    x = gt[0] + px * gt[1] + py * gt[2]
    y = gt[3] + px * gt[4] + py * gt[5]
    return x, y


def shifted(gt: Column, px: Column, py: Column) -> Column:
    """The geotransform of a window that begins at pixel (px, py)."""
    x, y = to_geo(px, py, gt)
    return F.array(x, gt[1], gt[2], y, gt[4], gt[5])


def box_of(gt: Column, x: Column, y: Column, width: Column, height: Column) -> dict[str, Column]:
    """Bounds in map coordinates of a pixel rectangle: all four corners, so that rotation counts."""
    corners = [to_geo(x + dx * width, y + dy * height, gt) for dx in (0, 1) for dy in (0, 1)]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return {"minx": F.least(*xs), "miny": F.least(*ys), "maxx": F.greatest(*xs), "maxy": F.greatest(*ys)}


def pixel_box(gt: Column, x0: int, y0: int, x1: int, y1: int) -> dict[str, Column]:
    """A rectangle of pixels as a mask box in map coordinates, from two of its corners."""
    (ax, ay), (bx, by) = (to_geo(F.lit(x), F.lit(y), gt) for x, y in ((x0, y0), (x1, y1)))
    return {"x0": F.least(ax, bx), "y0": F.least(ay, by), "x1": F.greatest(ax, bx), "y1": F.greatest(ay, by)}


def file_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(path, "/"), -1)


def base_name(path: Column) -> Column:
    """The file's name without its extension."""
    return F.regexp_replace(file_name(path), "[.][^.]*$", "")


def window_of(bounds: Sequence[Column], gt: Column, width: Column, height: Column, cover: bool = False) -> dict[str, Column]:
    """Pixel window of map bounds (minx, miny, maxx, maxy) in a north-up raster.

    Offsets are truncated and sizes rounded up before either is clamped to the raster; with
    `cover` the size also counts the part of a pixel that truncation moved the offset by.
    """
    minx, miny, maxx, maxy = bounds
    fx, fy = (minx - gt[0]) / gt[1], (maxy - gt[3]) / gt[5]
    x0, y0 = fx.cast("int"), fy.cast("int")
    w, h = F.ceil((maxx - minx) / gt[1]), F.ceil((miny - maxy) / gt[5])
    if cover:
        w, h = F.ceil((maxx - gt[0]) / gt[1]) - x0, F.ceil((miny - gt[3]) / gt[5]) - y0
    x, y = F.greatest(F.lit(0), x0), F.greatest(F.lit(0), y0)
    return {"x_off": x, "y_off": y, "x_size": F.least(w, width - x).cast("int"), "y_size": F.least(h, height - y).cast("int")}


def signed_unit(v: Column, lo: Column | float = 0.0, hi: Column | float = 255.0) -> Column:
    """v of the range lo..hi, moved to -1..1; 0 where the range is empty."""
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lo, hi))
    return F.when(hi == lo, 0.0).otherwise((v - lo) / F.nullif(hi - lo, F.lit(0.0)) * 2 - 1)


def byte_of_signed(v: Column) -> Column:
    """-1..1 as 0..255, clipped first and rounded half to even."""
    return F.rint((F.least(F.greatest(v, F.lit(-1.0)), F.lit(1.0)) + 1) / 2 * 255).cast("int")


def byte_clip(v: Column) -> Column:
    """v rounded half to even and held to 0..255."""
    return F.rint(F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0))).cast("int")


def is_nodata(v: Column, nodata: Column) -> Column:
    """Whether v is close to the NoData value (1e-8 + 1e-5 * |nodata|); false for NaN or without a NoData value."""
    near = F.abs(v - nodata) <= 1e-8 + 1e-5 * F.abs(nodata)
    return F.coalesce(near & ~F.isnan(v) & ~F.isnan(nodata), F.lit(False))


def radial_weight(i: Column, j: Column, size: int, width: int | None = None) -> Column:
    """Weight of pixel (i, j) of a tile: one less the distance to pixel size // 2 over that of a corner, and 1e-4."""
    ci, cj = size // 2, (width or size) // 2
    if ci == 0 and cj == 0:
        return F.lit(1.0001)
    reach = float((ci * ci + cj * cj) ** 0.5)
    return F.lit(1.0) - F.sqrt(((i - ci) * (i - ci) + (j - cj) * (j - cj)).cast("double")) / reach + 1e-4


def covering_starts(at: Column, length: int, size: int, stride: int) -> Column:
    """Starts of all tiles of an axis that cover position `at`: those of the regular grid, then the one flush with the end.

    Arithmetic in place of a range join: a pixel finds its tiles without meeting any other row.
    """
    n = (length - size) // stride + 1
    lo = F.greatest(F.lit(0), F.floor((at - size + stride) / stride)).cast("int")
    hi = F.least(F.lit(n - 1), F.floor(at / stride)).cast("int")
    regular = F.when(lo <= hi, F.transform(F.sequence(lo, hi), lambda k: k * stride)).otherwise(F.array().cast("array<int>"))
    if (n - 1) * stride + size >= length:
        return regular
    return F.concat(regular, F.when(at >= length - size, F.array(F.lit(length - size))).otherwise(F.array().cast("array<int>")))


def place_key(a: Column, b: Column, factor: int) -> Column:
    """a * factor + b as one key of the noise, for any size of grid: in 64 bits, and less than the modulus, by which it is the same key."""
    return F.pmod(a.cast("long") * factor + b, F.lit(NOISE_MODULUS))


def noise_seed(*keys: Column | int, seed: int = 0) -> Column:
    """A 31-bit value that depends on the keys and the seed alone, however rows are dealt to tasks."""
    total = F.lit(seed).cast("long") + 1
    for k, m in zip(keys, NOISE_KEYS, strict=False):
        total = total + (k if isinstance(k, Column) else F.lit(k)).cast("long") * m
    value = F.pmod(total, F.lit(NOISE_MODULUS))
    for add in NOISE_ROUNDS:
        value = F.pmod(value * NOISE_STEP + add, F.lit(NOISE_MODULUS))
        value = F.pmod(value * (value + add), F.lit(NOISE_MODULUS))  # affine steps alone would leave streams of other seeds alike
    return value


def uniform(*keys: Column | int, seed: int = 0) -> Column:
    """A number inside (0, 1) for the keys."""
    return (noise_seed(*keys, seed=seed) + 0.5) / float(NOISE_MODULUS)


def gaussian(*keys: Column | int, seed: int = 0) -> Column:
    """A standard normal number for the keys, by the Box-Muller transform."""
    return F.sqrt(-2 * F.log(uniform(*keys, seed=seed))) * F.cos(2 * F.pi() * uniform(*keys, seed=seed + 1000003))
