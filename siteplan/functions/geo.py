"""Distances, projections and point/polygon/box predicates as column expressions.

A point is two DOUBLE columns. A polygon is ``rings ARRAY<ARRAY<STRUCT<x, y>>>``, outer ring first,
every ring closed. A box is four columns west, south, east, north.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

# Mean Earth radius in km, WGS84 semi-major axis in m and flattening, metres per unit.
EARTH_RADIUS_KM = 6371.0088
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UNIT_METERS = {"meters": 1.0, "kilometers": 1000.0}


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def haversine(lon1, lat1, lon2, lat2, units: str = "kilometers") -> Column:
    """Great-circle distance; the half-chord square is clipped to [0, 1] before the root."""
    lon1, lat1, lon2, lat2 = (F.radians(_c(v)) for v in (lon1, lat1, lon2, lat2))
    return great_circle(lon1, lat1, F.cos(lat1), lon2, lat2, F.cos(lat2), units)


def great_circle(lon1, lat1, cos1, lon2, lat2, cos2, units: str = "kilometers") -> Column:
    """``haversine`` of angles in radians and the cosines of the latitudes."""
    lon1, lat1, cos1, lon2, lat2, cos2 = map(_c, (lon1, lat1, cos1, lon2, lat2, cos2))
    half_lat, half_lon = F.sin((lat2 - lat1) / 2), F.sin((lon2 - lon1) / 2)
    h = half_lat * half_lat + cos1 * cos2 * half_lon * half_lon
    clipped = F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0))
    return F.asin(F.sqrt(clipped)) * (2 * EARTH_RADIUS_KM * 1000 / UNIT_METERS[units])


def euclidean(x1, y1, x2, y2, meters_per_unit: float = 1.0, units: str = "meters") -> Column:
    dx, dy = _c(x1) - _c(x2), _c(y1) - _c(y2)
    return F.sqrt(dx * dx + dy * dy) * (meters_per_unit / UNIT_METERS[units])


def _reduced(lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sine and cosine of the reduced latitude."""
    tangent = (1 - WGS84_F) * np.tan(np.radians(lat))
    cosine = 1 / np.sqrt(1 + tangent * tangent)
    return tangent * cosine, cosine


@arrow_udf(T.DoubleType())
def _inverse_meters(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    # Vincenty's published inverse iteration, vectorised over one Arrow batch.
    a, f = WGS84_A, WGS84_F
    b = a * (1 - f)
    for batch in batches:
        lon1, lat1, lon2, lat2 = (c.to_numpy(zero_copy_only=False).astype(float) for c in batch)
        with np.errstate(all="ignore"):
            span = np.radians(lon2 - lon1)
            (s1, c1), (s2, c2) = _reduced(lat1), _reduced(lat2)
            ss, cc, cs, sc = s1 * s2, c1 * c2, c1 * s2, s1 * c2
            lam = span
            moved = np.full(span.shape, np.inf)
            for _ in range(200):
                sl, cl = np.sin(lam), np.cos(lam)
                east, north = c2 * sl, cs - sc * cl
                sin_sigma = np.sqrt(east * east + north * north)
                cos_sigma = ss + cc * cl
                sigma = np.arctan2(sin_sigma, cos_sigma)
                sin_alpha = np.where(sin_sigma == 0, 0.0, cc * sl / sin_sigma)
                cos2_alpha = 1 - sin_alpha * sin_alpha
                cos_2m = np.where(cos2_alpha <= 1e-15, 0.0, cos_sigma - 2 * ss / cos2_alpha)
                twice = 2 * cos_2m * cos_2m - 1
                k = f / 16 * cos2_alpha * (4 + f * (4 - 3 * cos2_alpha))
                fresh = span + (1 - k) * f * sin_alpha * (sigma + k * sin_sigma * (cos_2m + k * cos_sigma * twice))
                moved, lam = np.abs(fresh - lam), fresh
                if not (moved > 1e-12).any():
                    break
            q = cos2_alpha * ((a * a - b * b) / (b * b))
            big_a = 1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q)))
            big_b = q / 1024 * (256 + q * (-128 + q * (74 - 47 * q)))
            delta = big_b * sin_sigma * (
                cos_2m + big_b / 4 * (cos_sigma * twice - big_b / 6 * cos_2m * (4 * sin_sigma * sin_sigma - 3) * (4 * cos_2m * cos_2m - 3))
            )
            meters = np.where(sin_sigma == 0, 0.0, b * big_a * (sigma - delta))
            # Nearly opposite points do not converge; they stay missing.
            lost = ~(moved <= 1e-12) | np.isnan(meters)
        yield pa.array(meters, mask=lost)


def geodesic(lon1, lat1, lon2, lat2, units: str = "meters") -> Column:
    """WGS84 ellipsoid distance; null where the iteration does not converge."""
    return _inverse_meters(_c(lon1), _c(lat1), _c(lon2), _c(lat2)) / UNIT_METERS[units]


def to_web_mercator(lon, lat) -> tuple[Column, Column]:
    """EPSG:4326 to EPSG:3857."""
    x = F.radians(_c(lon)) * WGS84_A
    y = F.log(F.tan(F.lit(math.pi / 4) + F.radians(_c(lat)) / 2)) * WGS84_A
    return x, y


def from_web_mercator(x, y) -> tuple[Column, Column]:
    """EPSG:3857 to EPSG:4326."""
    lon = F.degrees(_c(x) / WGS84_A)
    lat = F.degrees(F.atan(F.exp(_c(y) / WGS84_A)) * 2 - math.pi / 2)
    return lon, lat


def transform_point(x, y, source: str, target: str) -> tuple[Column, Column]:
    if source == target:
        return _c(x), _c(y)
    if (source, target) == ("EPSG:4326", "EPSG:3857"):
        return to_web_mercator(x, y)
    if (source, target) == ("EPSG:3857", "EPSG:4326"):
        return from_web_mercator(x, y)
    raise ValueError(f"unsupported CRS pair {source} to {target}")


def box_rings(west, south, east, north) -> Column:
    """The closed ring of a box, as a polygon."""
    west, south, east, north = map(_c, (west, south, east, north))

    def corner(x: Column, y: Column) -> Column:
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    ring = F.array(
        corner(west, south), corner(east, south), corner(east, north), corner(west, north), corner(west, south)
    )
    return F.array(ring)


def _segments(rings: Column) -> Column:
    return F.flatten(
        F.transform(
            rings,
            lambda ring: F.zip_with(
                F.slice(ring, F.lit(1), F.size(ring) - 1),
                F.slice(ring, F.lit(2), F.size(ring) - 1),
                lambda p, q: F.struct(
                    p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")
                ),
            ),
        )
    )


def segments(rings) -> Column:
    """The edges of a polygon: ``x1, y1, x2, y2``."""
    return _segments(_c(rings))


def on_boundary(x, y, rings) -> Column:
    x, y = _c(x), _c(y)
    return F.exists(
        _segments(_c(rings)),
        lambda s: ((s["x2"] - s["x1"]) * (y - s["y1"]) == (s["y2"] - s["y1"]) * (x - s["x1"]))
        & x.between(F.least(s["x1"], s["x2"]), F.greatest(s["x1"], s["x2"]))
        & y.between(F.least(s["y1"], s["y2"]), F.greatest(s["y1"], s["y2"])),
    )


def edge_directions(x, y, rings) -> Column:
    """Angles at which edges of a polygon leave a point on its boundary."""
    x, y = _c(x), _c(y)
    at = F.filter(
        _segments(_c(rings)),
        lambda s: ((s["x2"] - s["x1"]) * (y - s["y1"]) == (s["y2"] - s["y1"]) * (x - s["x1"]))
        & x.between(F.least(s["x1"], s["x2"]), F.greatest(s["x1"], s["x2"]))
        & y.between(F.least(s["y1"], s["y2"]), F.greatest(s["y1"], s["y2"])),
    )
    ends = F.flatten(F.transform(at, lambda s: F.array(F.struct(s["x1"].alias("x"), s["y1"].alias("y")), F.struct(s["x2"].alias("x"), s["y2"].alias("y")))))
    away = F.filter(ends, lambda e: (e["x"] != x) | (e["y"] != y))
    return F.array_distinct(F.transform(away, lambda e: F.atan2(e["y"] - y, e["x"] - x)))


def inside_rings(x, y, rings) -> Column:
    """Even-odd rule; points on the boundary are decided by ``on_boundary`` first."""
    return inside_segments(x, y, _segments(_c(rings)))


def inside_segments(x, y, edges) -> Column:
    """``inside_rings`` for the edges of a polygon."""
    x, y = _c(x), _c(y)

    def crossed(s: Column) -> Column:
        rise = s["y2"] - s["y1"]
        left = (x - s["x1"]) * rise
        right = (s["x2"] - s["x1"]) * (y - s["y1"])
        straddles = (s["y1"] > y) != (s["y2"] > y)
        return straddles & F.when(rise > 0, left < right).otherwise(left > right)

    return F.size(F.filter(_c(edges), crossed)) % 2 == 1


def point_polygon(x, y, rings, predicate: str) -> Column:
    """Relation of a point (left) to a polygon (right)."""
    edge = on_boundary(x, y, rings)
    if predicate == "within":
        return ~edge & inside_rings(x, y, rings)
    if predicate == "intersects":
        return edge | inside_rings(x, y, rings)
    if predicate == "touches":
        return edge
    if predicate in ("contains", "covers"):
        return F.lit(False)
    raise ValueError(f"unknown predicate {predicate}")


def polygon_point(x, y, rings, predicate: str) -> Column:
    """Relation of a polygon (left) to a point (right)."""
    swapped = {"contains": "within", "covers": "intersects", "within": "contains"}
    return point_polygon(x, y, rings, swapped.get(predicate, predicate))


def zone_feature(x, y, rings, predicate: str) -> Column:
    """Zonal reading: ``within`` and ``contains`` both mean strictly inside the zone."""
    return point_polygon(x, y, rings, {"contains": "within", "covers": "intersects"}.get(predicate, predicate))


def box_box(left: str, right: str, predicate: str) -> Column:
    """Relation of two boxes whose columns are ``{prefix}west`` and so on."""
    lw, ls, le, ln = (F.col(left + n) for n in ("west", "south", "east", "north"))
    rw, rs, re, rn = (F.col(right + n) for n in ("west", "south", "east", "north"))
    meet = (lw <= re) & (rw <= le) & (ls <= rn) & (rs <= ln)
    overlap = (lw < re) & (rw < le) & (ls < rn) & (rs < ln)
    if predicate == "intersects":
        return meet
    if predicate == "touches":
        return meet & ~overlap
    if predicate == "within":
        return (lw >= rw) & (le <= re) & (ls >= rs) & (ln <= rn)
    if predicate in ("contains", "covers"):
        return (lw <= rw) & (le >= re) & (ls <= rs) & (ln >= rn)
    raise ValueError(f"unknown predicate {predicate}")


def valid_lonlat(lon, lat) -> Column:
    return _c(lon).between(-180, 180) & _c(lat).between(-90, 90)


def in_bbox(x, y, west: float, south: float, east: float, north: float) -> Column:
    return _c(x).between(west, east) & _c(y).between(south, north)
