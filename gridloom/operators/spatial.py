"""Raster extents, mask geometry and the patch index.

Masks are boxes (x0, y0, x1, y1) or rings. Boxes are joined by ranges and clipped in closed form;
rings are clipped against rectangles by a vectorised function. A mask layer drawn by hand is
small: it is broadcast below a checked number of rows. Beyond it, both sides are dealt to square cells
whose side follows from the boxes, and meet by equality. Unions of boxes are always formed cell by cell.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.columns import box_of, is_nodata, shifted
from gridloom.operators.tiling import complete_windows
from gridloom.sources.store import Snapshots, work_folder

#: Most mask rows that are broadcast to the rasters or patches.
MASK_ROWS = 200_000


def with_extent(rasters: DataFrame) -> DataFrame:
    """rasters (gt, width, height) with minx, miny, maxx, maxy of all four corners."""
    return rasters.withColumns(box_of(F.col("gt"), F.lit(0), F.lit(0), F.col("width"), F.col("height")))


def meets(left: DataFrame, masks: DataFrame, cell: float | None = None, rows: int | None = None) -> DataFrame:
    """left (minx ... maxy) with each mask box (x0 ... y1) that it touches; touching without area counts.

    Up to MASK_ROWS masks are broadcast; `rows` spares counting them. Beyond, give `cell`: both sides are dealt to the squares of
    that side which they overlap, meet by equality, and the pair is kept where its lower left corner lies.
    """
    near = (F.col("minx") <= F.col("x1")) & (F.col("x0") <= F.col("maxx")) & (F.col("miny") <= F.col("y1")) & (F.col("y0") <= F.col("maxy"))
    if (masks.limit(MASK_ROWS + 1).count() if rows is None else rows) <= MASK_ROWS:
        return left.join(F.broadcast(masks), near)
    if not cell:
        raise ValueError("a mask layer this large needs a cell size")
    squares = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    a = left.withColumn("__gx", squares("minx", "maxx")).withColumn("__gy", squares("miny", "maxy"))
    b = masks.withColumn("__gx", squares("x0", "x1")).withColumn("__gy", squares("y0", "y1"))
    own = (F.floor(F.greatest("minx", "x0") / cell) == F.col("__gx")) & (F.floor(F.greatest("miny", "y0") / cell) == F.col("__gy"))
    return a.join(b, ["__gx", "__gy"]).where(near & own).drop("__gx", "__gy")


def meeting(left: DataFrame, masks: DataFrame) -> DataFrame:
    """meets() of tables of any size: where masks are too many to broadcast, the side of the cells follows from both tables."""
    if masks.limit(MASK_ROWS + 1).count() <= MASK_ROWS:
        return meets(left, masks, rows=MASK_ROWS)
    return meets(left, masks, cell_side((left, "minx", "miny", "maxx", "maxy"), (masks, "x0", "y0", "x1", "y1")), MASK_ROWS + 1)


def settled(masks: DataFrame) -> DataFrame:
    """Masks written to the folder that all executors share, so that plans that use them several times don't make them again."""
    store = Snapshots(masks.sparkSession, f"{work_folder(masks.sparkSession)}/masks-{uuid.uuid4().hex}")
    return store.write(masks, 0)


def _side(lo: str, hi: str, a: str, b: str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.col(hi), F.col(b)) - F.greatest(F.col(lo), F.col(a)))


def shared_area() -> Column:
    """Area that a box (minx ... maxy) and a mask box (x0 ... y1) have in common."""
    return _side("minx", "maxx", "x0", "x1") * _side("miny", "maxy", "y0", "y1")


def cell_side(*boxes: tuple[DataFrame, str, str, str, str]) -> float:
    """A side for square cells: the power of two at or above the mean side of the boxes of the tables (x0, y0, x1, y1 by name).

    A box then overlaps some four cells, and cell bounds are exact numbers. 1 where there is no box with a side.
    """
    side = 0.0
    for table, x0, y0, x1, y1 in boxes:
        found = table.agg(F.avg(F.greatest(F.col(x1) - F.col(x0), F.col(y1) - F.col(y0)))).first()[0]
        side = max(side, found or 0.0)
    return 2.0 ** math.ceil(math.log2(side)) if 0 < side < math.inf else 1.0


def dealt_to_cells(masks: DataFrame, cell: float) -> DataFrame:
    """Mask boxes cut at the bounds of square cells (gx, gy); pieces without area are left out."""
    squares = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    out = masks.where("x1 > x0 and y1 > y0").withColumn("gx", squares("x0", "x1")).withColumn("gy", squares("y0", "y1"))
    lo, hi = (lambda c, g: F.greatest(F.col(c), F.col(g) * cell)), (lambda c, g: F.least(F.col(c), (F.col(g) + 1) * cell))
    return out.withColumns({"x0": lo("x0", "gx"), "x1": hi("x1", "gx"), "y0": lo("y0", "gy"), "y1": hi("y1", "gy")}).where("x1 > x0 and y1 > y0")


def disjoint_boxes(masks: DataFrame, keys: tuple[str, ...] = ("split",), cell: float | None = None) -> DataFrame:
    """The union of mask boxes of each key as boxes that don't overlap.

    Boxes are dealt to square cells of side `cell` (by default that of cell_side), and the union is formed in each by itself:
    the cell is cut at all x bounds of its boxes; within a strip, a running maximum of the upper
    bounds joins intervals that touch. Areas of the pieces add up without counting any twice. So the
    work grows with the boxes of a cell, not of a key.
    """
    masks = dealt_to_cells(masks.select(*keys, "x0", "y0", "x1", "y1"), cell or cell_side((masks, "x0", "y0", "x1", "y1")))
    split, keys = list(keys), [*keys, "gx", "gy"]
    cuts = masks.select(*keys, F.col("x0").alias("cut")).union(masks.select(*keys, F.col("x1").alias("cut"))).distinct()
    strips = cuts.withColumn("next", F.lead("cut").over(Window.partitionBy(*keys).orderBy("cut"))).where("next > cut")
    on = [F.col(f"m.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys] + [F.col("m.x0") <= F.col("s.cut"), F.col("m.x1") >= F.col("s.next")]
    pieces = masks.alias("m").join(strips.alias("s"), on).where("m.y1 > m.y0").select(*[F.col(f"m.{k}").alias(k) for k in keys], F.col("s.cut").alias("x0"), F.col("s.next").alias("x1"), "m.y0", "m.y1")
    line = Window.partitionBy(*keys, "x0").orderBy("y0", "y1")
    reach = F.max("y1").over(line.rowsBetween(Window.unboundedPreceding, -1))
    grouped = pieces.withColumn("begins", F.when(reach.isNull() | (F.col("y0") > reach), 1).otherwise(0)).withColumn("run", F.sum("begins").over(line))
    return grouped.groupBy(*keys, "x0", "run").agg(F.first("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1")).select(*split, "x0", "y0", "x1", "y1")


def valid_area(rasters: DataFrame, masks: DataFrame) -> DataFrame:
    """path, split, area: the area of a raster inside the masks of a split (boxes must not overlap); only where there is some."""
    return meeting(with_extent(rasters), masks).groupBy("path", "split").agg(F.sum(shared_area()).alias("area"))


def mask_bounds(masks: DataFrame, rasters: DataFrame) -> DataFrame:
    """path, minx, miny, maxx, maxy of the part of all masks inside a raster."""
    hit = meeting(with_extent(rasters), masks)
    return hit.groupBy("path").agg(F.min(F.greatest("minx", "x0")).alias("bx0"), F.min(F.greatest("miny", "y0")).alias("by0"), F.max(F.least("maxx", "x1")).alias("bx1"), F.max(F.least("maxy", "y1")).alias("by1"))


def patches(rasters: DataFrame, masks: DataFrame, size: int, stride: int, overlap: float) -> DataFrame:
    """Complete windows of rasters whose share inside the masks of a split is `overlap` or more.

    Rasters that meet no mask are dropped first; the rest follows from arithmetic on headers, and no pixel is read.
    Masks are used twice: give them settled(), if they are the result of a plan.
    """
    some = rasters.join(meeting(with_extent(rasters), masks).select("path").distinct(), "path", "left_semi")
    grid = complete_windows(some, size, stride)
    gt = F.col("gt")
    boxed = grid.withColumns(box_of(gt, F.col("x_offset"), F.col("y_offset"), F.lit(size), F.lit(size)))
    whole = (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))
    inside = meeting(boxed, masks).groupBy("path", "split", "x_offset", "y_offset").agg(F.sum(shared_area() / whole).alias("overlap_ratio"), F.first("gt").alias("gt"), F.first("wkt").alias("wkt"))
    kept = inside.where(F.col("overlap_ratio") >= overlap)
    return kept.select("path", "split", "x_offset", "y_offset", F.lit(size).alias("width"), F.lit(size).alias("height"), shifted(gt, F.col("x_offset"), F.col("y_offset")).alias("geotransform"), F.col("wkt").alias("projection"), "overlap_ratio")


def nodata_share(windows: DataFrame, pixels: DataFrame, nodata: Column, block: int = 256) -> DataFrame:
    """windows (path, x_offset, y_offset, width, height) with nodata_ratio over the pixels of their band.

    Windows and pixels meet in blocks of the grid, by equality; what lies outside a window is then
    filtered. A window without pixels has 0.
    """
    keys = ["path", "x_offset", "y_offset"]
    reach = lambda at, size: F.explode(F.sequence(F.expr(f"{at} div {block}"), F.expr(f"({at} + {size} - 1) div {block}")))
    dealt = windows.select(*keys, "width", "height").distinct().withColumn("by", reach("y_offset", "height")).withColumn("bx", reach("x_offset", "width"))
    flagged = pixels.select("path", "y", "x", F.when(is_nodata(F.col("v"), nodata), 1.0).otherwise(0.0).alias("__nd"), F.expr(f"cast(y as bigint) div {block}").alias("by"), F.expr(f"cast(x as bigint) div {block}").alias("bx"))
    inside = (F.col("y") >= F.col("y_offset")) & (F.col("y") < F.col("y_offset") + F.col("height")) & (F.col("x") >= F.col("x_offset")) & (F.col("x") < F.col("x_offset") + F.col("width"))
    ratio = dealt.join(flagged, ["path", "by", "bx"]).where(inside).groupBy(*keys).agg(F.avg("__nd").alias("nodata_ratio"))
    return windows.join(ratio, keys, "left").withColumn("nodata_ratio", F.coalesce("nodata_ratio", F.lit(0.0)))


def nodata_share_by_overview(windows: DataFrame, cells: DataFrame, scale: float, shape: tuple[int, int], nodata: Column) -> DataFrame:
    """The same from overview cells (path, oy, ox, v), as the parity mode: a cell counts if its mean is NoData.

    A window takes the cells from int(offset / scale), int(size / scale) of them and one at least, held to the overview's shape.
    """
    oh, ow = shape
    keys = ["path", "x_offset", "y_offset"]
    start = lambda c, n: F.least(F.lit(n - 1), (F.col(c) / scale).cast("int"))
    span = lambda c: F.greatest(F.lit(1), (F.col(c) / scale).cast("int"))
    asked = windows.select(*keys, start("x_offset", ow).alias("a"), start("y_offset", oh).alias("b"), span("width").alias("w"), span("height").alias("h")).distinct()
    asked = asked.withColumn("ox", F.explode(F.sequence("a", F.least(F.lit(ow), F.col("a") + F.col("w")) - 1))).withColumn("oy", F.explode(F.sequence("b", F.least(F.lit(oh), F.col("b") + F.col("h")) - 1)))
    ratio = asked.join(cells, ["path", "oy", "ox"]).groupBy(*keys).agg(F.avg(F.when(is_nodata(F.col("v"), nodata), 1.0).otherwise(0.0)).alias("nodata_ratio"))
    return windows.join(ratio, keys, "left").withColumn("nodata_ratio", F.coalesce("nodata_ratio", F.lit(0.0)))


def clip_ring(ring: list[tuple[float, float]], box: tuple[float, float, float, float]) -> list[tuple[float, float]]:
    """The part of a ring inside a box, cut at one side after the other; concave rings may leave edges of no area."""
    x0, y0, x1, y1 = box
    for axis, bound, keep in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        out, inside = [], lambda p, a=axis, b=bound, k=keep: (p[a] - b) * k >= 0
        for p, q in zip(ring[-1:] + ring[:-1], ring, strict=True):
            if inside(p) != inside(q):
                t = (bound - p[axis]) / (q[axis] - p[axis])
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
            if inside(q):
                out.append(tuple(q))
        ring = out
        if not ring:
            break
    return ring


def ring_area(ring: list[tuple[float, float]]) -> float:
    """Area of a ring, whichever way it turns."""
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def clipped_area(pairs: DataFrame) -> DataFrame:
    """pairs (ring array of x, y; minx ... maxy) with `area` of the ring inside the box. A null or short ring has none."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            area = []
            for ring, *box in zip(pdf["ring"], pdf["minx"], pdf["miny"], pdf["maxx"], pdf["maxy"], strict=True):
                points = [(p["x"], p["y"]) for p in ring] if ring is not None else []
                area.append(ring_area(clip_ring(points, tuple(box))) if len(points) > 2 else 0.0)
            yield pdf.assign(area=area)

    schema = T.StructType([*pairs.schema.fields, T.StructField("area", T.DoubleType())])
    return pairs.mapInPandas(rows, schema)
