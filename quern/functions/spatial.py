"""Distances and containment on points in microdegrees; all expressions stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
POINT_TYPE = "struct<lat_e6:int,lon_e6:int>"
#: A box is wider than its radius by this factor.
BOX_SLACK = 1.05


def point(lat_e6: Column | int, lon_e6: Column | int) -> Column:
    col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(col(lat_e6).cast("int").alias("lat_e6"), col(lon_e6).cast("int").alias("lon_e6"))


def distance_m(p: Column, lat_e6: int, lon_e6: int, metric: str = "HAVERSINE") -> Column:
    """Metres: HAVERSINE on a sphere, or EUCLIDIANA in radians times the radius, without a factor for the longitude."""
    lat, lon = F.radians(p["lat_e6"] / 1e6), F.radians(p["lon_e6"] / 1e6)
    lat0, lon0 = math.radians(lat_e6 / 1e6), math.radians(lon_e6 / 1e6)
    if metric == "EUCLIDIANA":
        return F.sqrt((lat - lat0) * (lat - lat0) + (lon - lon0) * (lon - lon0)) * EARTH_M
    a, b = F.sin((lat - lat0) / 2), F.sin((lon - lon0) / 2)
    h = a * a + F.cos(lat) * math.cos(lat0) * b * b
    return F.asin(F.sqrt(F.least(F.lit(1.0), h))) * (2 * EARTH_M)


def in_box(p: Column, lat: tuple[int, int], lon: tuple[int, int]) -> Column:
    return p["lat_e6"].between(*lat) & p["lon_e6"].between(*lon)


def radius_box(lat_e6: int, lon_e6: int, metres: float, metric: str = "HAVERSINE") -> tuple[tuple[int, int], tuple[int, int]] | None:
    """A box that holds every point within the radius; None where it would meet a pole or the antimeridian."""
    reach = math.degrees(metres * BOX_SLACK / EARTH_M)
    lat = lat_e6 / 1e6
    far = max(abs(lat - reach), abs(lat + reach))
    if far >= 89:
        return None
    wide = reach if metric == "EUCLIDIANA" else reach / math.cos(math.radians(far))
    if abs(lon_e6 / 1e6) + wide >= 180:
        return None
    low = lambda v, r: (math.floor(v - r * 1e6) - 1, math.ceil(v + r * 1e6) + 1)
    return low(lat_e6, reach), low(lon_e6, wide)


def within(p: Column, lat_e6: int, lon_e6: int, op: str, metres: float, metric: str = "HAVERSINE") -> Column:
    """distance op metres; a bounding box, which a scan can push down, stands before an upper bound."""
    d = distance_m(p, lat_e6, lon_e6, metric)
    test = {"<": d < metres, "<=": d <= metres, ">": d > metres, ">=": d >= metres}[op]
    box = radius_box(lat_e6, lon_e6, metres, metric) if op in ("<", "<=") else None
    return in_box(p, *box) & test if box else test


def inside(p: Column, polygon: list[tuple[int, int]]) -> Column:
    """Even-odd containment in whole microdegrees; the border counts as inside."""
    x, y = p["lon_e6"].cast("long"), p["lat_e6"].cast("long")
    lats, lons = [a for a, _ in polygon], [b for _, b in polygon]
    on_edge, odd = F.lit(False), F.lit(0)
    for (y1, x1), (y2, x2) in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
        cross = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
        on_edge = on_edge | ((cross == 0) & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2)))
        if y1 != y2:
            # A ray to the right crosses the edge if the point lies to the left of it, seen upwards.
            left = cross < 0 if y2 > y1 else cross > 0
            odd = odd + (((y >= min(y1, y2)) & (y < max(y1, y2))) & left).cast("int")
    return in_box(p, (min(lats), max(lats)), (min(lons), max(lons))) & (on_edge | (odd % 2 == 1))
