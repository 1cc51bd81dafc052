"""Polygon layers: the shapefile geometry file (.shp) with its .prj, read through Spark and written by the driver."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

POLYGON = 5
SCHEMA = "path string, geom_id int, part int, ring array<struct<x: double, y: double>>, x0 double, y0 double, x1 double, y1 double"


def parse_polygons(content: bytes) -> list[tuple[int, int, list[tuple[float, float]]]]:
    """(record, part, points) of every ring of a polygon file; records of other kinds are left out."""
    out, at, end = [], 100, struct.unpack(">i", content[24:28])[0] * 2
    while at < min(end, len(content)):
        number, words = struct.unpack_from(">2i", content, at)
        if struct.unpack_from("<i", content, at + 8)[0] == POLYGON:
            parts, points = struct.unpack_from("<2i", content, at + 44)
            first = [*struct.unpack_from(f"<{parts}i", content, at + 52), points]
            flat = struct.unpack_from(f"<{2 * points}d", content, at + 52 + 4 * parts)
            for k in range(parts):
                out.append((number - 1, k, [(flat[2 * i], flat[2 * i + 1]) for i in range(first[k], first[k + 1])]))
        at += 8 + 2 * words
    return out


def read_polygons(spark: SparkSession, root: str) -> DataFrame:
    """One row a ring of the .shp files at or below root, with its bounds; the closing point is left out."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                for number, part, ring in parse_polygons(content):
                    ring = ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring
                    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
                    made.append((path, number, part, [{"x": x, "y": y} for x, y in ring], min(xs), min(ys), max(xs), max(ys)))
            yield pd.DataFrame(made, columns=["path", "geom_id", "part", "ring", "x0", "y0", "x1", "y1"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.shp").load(root)
    return files.select("path", "content").mapInPandas(rows, SCHEMA)


def reference_of(spark: SparkSession, root: str) -> str | None:
    """The reference system of the layer at or below root: the text of its .prj files, None without any; different texts are an error."""
    at = root.removesuffix(".shp") + ".prj" if root.endswith(".shp") else root
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    texts = {r.value for r in spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.prj").text(at, wholetext=True).collect()}  # a line a layer
    if len(texts) > 1:
        raise ValueError(f"layers below {root} have different reference systems")
    return texts.pop().strip() if texts else None


def write_boxes(path: str, boxes: list[tuple[float, float, float, float]], wkt: str = "") -> None:
    """A polygon layer of boxes: .shp, .shx and, with a reference system, .prj."""
    records, index, at = b"", b"", 50
    for k, (x0, y0, x1, y1) in enumerate(boxes, 1):
        ring = [(x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0)]
        body = struct.pack("<i4d2ii", POLYGON, x0, y0, x1, y1, 1, 5, 0) + b"".join(struct.pack("<2d", *p) for p in ring)
        records += struct.pack(">2i", k, len(body) // 2) + body
        index += struct.pack(">2i", at, len(body) // 2)
        at += 4 + len(body) // 2
    bounds = (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)) if boxes else (0.0,) * 4
    for name, body in ((path, records), (path.removesuffix(".shp") + ".shx", index)):
        with open(name, "wb") as file:
            file.write(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, POLYGON, *bounds, 0, 0, 0, 0) + body)
    if wkt:
        with open(path.removesuffix(".shp") + ".prj", "w") as file:
            file.write(wkt)
