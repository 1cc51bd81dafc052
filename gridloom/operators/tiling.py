"""Tables of windows over a grid, and the expansion of pixels into the windows that cover them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.columns import covering_starts, radial_weight


def _check(height: int, width: int, size_h: int, size_w: int) -> None:
    if height < size_h or width < size_w:
        raise ValueError(f"a {height}x{width} scene is smaller than a {size_h}x{size_w} tile")


def tile_count(length: int, size: int, stride: int) -> tuple[int, bool]:
    """Regular windows of an axis, and whether one more is needed flush with its end."""
    n = (length - size) // stride + 1
    return n, (n - 1) * stride + size < length


def views(spark: SparkSession, height: int, width: int, size: int, stride: int, size_w: int | None = None, stride_w: int | None = None) -> DataFrame:
    """Overlapping tiles that cover a scene: tile_id, h0, w0, h1, w1.

    Tiles are numbered row by row over the regular grid, then along the bottom strip, then down
    the right strip, then the corner. A stride beyond the tile leaves gaps, which stay uncovered.
    """
    size_w, stride_w = size_w or size, stride_w or stride
    _check(height, width, size, size_w)
    (nh, bottom), (nw, right) = tile_count(height, size, stride), tile_count(width, size_w, stride_w)
    i = spark.range(nh + bottom).select(F.col("id").alias("i"))
    j = spark.range(nw + right).select(F.col("id").alias("j"))
    low, edge = F.col("i") >= nh, F.col("j") >= nw
    number = F.when(low & edge, F.lit(nh * nw + bottom * nw + right * nh)).when(edge, nh * nw + bottom * nw + F.col("i")).when(low, nh * nw + F.col("j")).otherwise(F.col("i") * nw + F.col("j"))
    h0 = F.when(low, F.lit(height - size)).otherwise(F.col("i") * stride)
    w0 = F.when(edge, F.lit(width - size_w)).otherwise(F.col("j") * stride_w)
    grid = i.crossJoin(j)  # the table of tiles itself, one row a tile
    return grid.select(number.cast("int").alias("tile_id"), h0.cast("int").alias("h0"), w0.cast("int").alias("w0"), (h0 + size).cast("int").alias("h1"), (w0 + size_w).cast("int").alias("w1"))


def complete_windows(rasters: DataFrame, size: int, stride: int) -> DataFrame:
    """Rows of rasters (width, height) for every window that fits whole: x_offset, y_offset. None where the raster is smaller."""
    fits = rasters.where((F.col("height") >= size) & (F.col("width") >= size))
    starts = lambda c: F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col(c) - size).cast("int"), F.lit(stride)))
    return fits.withColumn("y_offset", starts("height")).withColumn("x_offset", starts("width"))


def chunked(pixels: DataFrame, size_h: int, size_w: int | None = None) -> DataFrame:
    """pixels with by, bx: the chunk of a grid without overlap, ragged at its edges."""
    return pixels.withColumns({"by": F.expr(f"y div {size_h}").cast("int"), "bx": F.expr(f"x div {size_w or size_h}").cast("int")})


def slabs(pixels: DataFrame, rows: int = 1024) -> DataFrame:
    """pixels with slab: horizontal strips of `rows` rows."""
    return pixels.withColumn("slab", F.expr(f"y div {rows}").cast("int"))


def batches(rows: DataFrame, number: Column, size: int) -> DataFrame:
    """rows with batch, slot: groups of a fixed size over a dense number; the last may be short."""
    return rows.withColumns({"batch": F.floor(number / size).cast("int"), "slot": F.pmod(number, F.lit(size)).cast("int")})


def covered(pixels: DataFrame, height: int, width: int, size: int, stride: int) -> DataFrame:
    """A row for each pixel and tile that covers it: h0, w0, i, j and the weight w of the place in the tile.

    It is a projection, not a join; the rows grow by the number of tiles over a pixel,
    at most (1 + size // stride) + 1 on each axis.
    """
    _check(height, width, size, size)
    out = pixels.withColumn("h0", F.explode(covering_starts(F.col("y"), height, size, stride)))
    out = out.withColumn("w0", F.explode(covering_starts(F.col("x"), width, size, stride)))
    out = out.withColumns({"i": F.col("y") - F.col("h0"), "j": F.col("x") - F.col("w0")})
    return out.withColumn("w", radial_weight(F.col("i"), F.col("j"), size))


def guidance(spark: SparkSession, size: int) -> DataFrame:
    """The weight map of a tile as a table: i, j, w."""
    cells = spark.range(size * size).select(F.expr(f"cast(id div {size} as int)").alias("i"), F.expr(f"cast(id % {size} as int)").alias("j"))
    return cells.withColumn("w", radial_weight(F.col("i"), F.col("j"), size))
