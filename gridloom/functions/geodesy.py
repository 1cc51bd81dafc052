"""Map coordinates of WGS 84: geographic (longitude, latitude) and the UTM zones, by Krüger's series, as column expressions.

The series run to the third power of the third flattening; within a zone they are good to a millimetre.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the ellipsoid and the projection.
AXIS, FLATTENING, SCALE, EAST, SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
_N = FLATTENING / (2 - FLATTENING)
RADIUS = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
GEOGRAPHIC = (0, False)


def zone_of(reference: str | None) -> tuple[int, bool] | None:
    """(UTM zone, whether south) of the text of a reference system; (0, False) for geographic WGS 84; None for any other."""
    text = reference or ""
    named = re.search(r"UTM[ _]zone[ _](\d{1,2})([NS])", text, re.I)
    if named:
        return int(named.group(1)), named.group(2).upper() == "S"
    coded = re.search(r"\b(?:EPSG[^0-9]{0,4})?32([67])(\d\d)\b", text)
    if coded and 1 <= int(coded.group(2)) <= 60:
        return int(coded.group(2)), coded.group(1) == "7"
    if re.search(r"\b4326\b", text) or (re.search(r"WGS[ _]?(19)?84", text) and "PROJCS" not in text and "PROJCRS" not in text):
        return GEOGRAPHIC
    return None


def _meridian(zone: int) -> float:
    return math.radians(6 * zone - 183)


def to_utm(lon: Column, lat: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Easting and northing of degrees."""
    root = 2 * math.sqrt(_N) / (1 + _N)
    sin, turn = F.sin(F.radians(lat)), F.radians(lon) - _meridian(zone)
    t = F.sinh(F.atanh(sin) - F.atanh(sin * root) * root)
    xi, eta = F.atan2(t, F.cos(turn)), F.atanh(F.sin(turn) / F.sqrt(1 + t * t))
    north, east = xi, eta
    for j, a in enumerate(ALPHA, 1):
        north = north + F.sin(xi * 2 * j) * F.cosh(eta * 2 * j) * a
        east = east + F.cos(xi * 2 * j) * F.sinh(eta * 2 * j) * a
    return east * SCALE * RADIUS + EAST, north * SCALE * RADIUS + (SOUTH if south else 0.0)


def from_utm(x: Column, y: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Longitude and latitude, in degrees, of an easting and a northing."""
    xi, eta = (y - (SOUTH if south else 0.0)) / (SCALE * RADIUS), (x - EAST) / (SCALE * RADIUS)
    north, east = xi, eta
    for j, b in enumerate(BETA, 1):
        north = north - F.sin(xi * 2 * j) * F.cosh(eta * 2 * j) * b
        east = east - F.cos(xi * 2 * j) * F.sinh(eta * 2 * j) * b
    chi = F.asin(F.sin(north) / F.cosh(east))
    lat = chi
    for j, d in enumerate(DELTA, 1):
        lat = lat + F.sin(chi * 2 * j) * d
    return F.degrees(F.atan2(F.sinh(east), F.cos(north))) + math.degrees(_meridian(zone)), F.degrees(lat)


def moved(x: Column, y: Column, source: str, target: str) -> tuple[Column, Column]:
    """A point of one reference system in another; equal texts are one system. A system that isn't known here is an error."""
    if source == target:
        return x, y
    a, b = zone_of(source), zone_of(target)
    if a is None or b is None:
        raise ValueError(f"points can't be moved from {source!r} to {target!r}")
    if a == b:
        return x, y
    lon, lat = (x, y) if a == GEOGRAPHIC else from_utm(x, y, *a)
    return (lon, lat) if b == GEOGRAPHIC else to_utm(lon, lat, *b)


def moved_boxes(boxes: DataFrame, source: str, target: str) -> DataFrame:
    """boxes (x0, y0, x1, y1) in another reference system: the bounds of their four corners."""
    corners = [moved(F.col(x), F.col(y), source, target) for x in ("x0", "x1") for y in ("y0", "y1")]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return boxes.withColumns({"x0": F.least(*xs), "y0": F.least(*ys), "x1": F.greatest(*xs), "y1": F.greatest(*ys)})


def moved_rings(layer: DataFrame, source: str, target: str) -> DataFrame:
    """A polygon layer (ring, x0 ... y1) in another reference system: every point moves, and the bounds follow."""
    point = lambda p: F.struct(*[c.alias(n) for c, n in zip(moved(p["x"], p["y"], source, target), "xy", strict=True)])
    out = layer.withColumn("ring", F.transform("ring", point))
    side = lambda n: F.transform("ring", lambda p: p[n])
    return out.withColumns({"x0": F.array_min(side("x")), "y0": F.array_min(side("y")), "x1": F.array_max(side("x")), "y1": F.array_max(side("y"))})
