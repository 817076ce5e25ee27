"""Spherical and planar geometry, wind. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
#: Strips within this unoriented bearing difference and distance are near-parallel.
PARALLEL_DEG, PARALLEL_M = 15.0, 2_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing, 0 to 360."""
    p, q, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    a = F.degrees(F.atan2(F.sin(d) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d)))
    return F.pmod(a + 360.0, F.lit(360.0))


def project_m(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Local metres east and north of an origin."""
    k = F.lit(EARTH_M) * F.radians(F.lit(1.0))
    return (lon - lon0) * k * F.cos(F.radians(lat0)), (lat - lat0) * k


def bearing_gap(a: Column, b: Column) -> Column:
    """Unoriented difference of two bearings, 0 to 90."""
    return F.abs(F.pmod(a - b + 90.0, F.lit(180.0)) - 90.0)


def _cross(ax, ay, bx, by, cx, cy) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def _on_box(ax, ay, bx, by, px, py) -> Column:
    return px.between(F.least(ax, bx), F.greatest(ax, bx)) & py.between(F.least(ay, by), F.greatest(ay, by))


def segments_cross(a, b, c, d) -> Column:
    """Closed segments a-b and c-d meet; each point is a pair of columns. Touching ends and overlaps count."""
    o1, o2, o3, o4 = _cross(*a, *b, *c), _cross(*a, *b, *d), _cross(*c, *d, *a), _cross(*c, *d, *b)
    proper = (F.signum(o1) * F.signum(o2) < 0) & (F.signum(o3) * F.signum(o4) < 0)
    touch = ((o1 == 0) & _on_box(*a, *b, *c)) | ((o2 == 0) & _on_box(*a, *b, *d)) | ((o3 == 0) & _on_box(*c, *d, *a)) | ((o4 == 0) & _on_box(*c, *d, *b))
    return proper | touch


def point_segment_m(p, a, b) -> Column:
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = dx * dx + dy * dy
    k = F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / F.nullif(n, F.lit(0.0)))))
    return F.sqrt(F.pow(p[0] - a[0] - k * dx, 2) + F.pow(p[1] - a[1] - k * dy, 2))


def segments_m(a, b, c, d) -> Column:
    near = F.least(point_segment_m(a, c, d), point_segment_m(b, c, d), point_segment_m(c, a, b), point_segment_m(d, a, b))
    return F.when(segments_cross(a, b, c, d), F.lit(0.0)).otherwise(near)


def wind(heading: Column, wind_from: Column, speed: Column) -> tuple[Column, Column, Column]:
    """Headwind, tailwind (at least 0) and absolute crosswind; null where direction or speed is not valid."""
    ok = wind_from.between(0, 360) & (speed >= 0) & heading.isNotNull()
    a = F.radians(wind_from - heading)
    head, cross = speed * F.cos(a), F.abs(speed * F.sin(a))
    return F.when(ok, head), F.when(ok, F.greatest(-head, F.lit(0.0))), F.when(ok, cross)
