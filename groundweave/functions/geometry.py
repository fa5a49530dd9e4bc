"""Geometry as Column expressions: projections, affines (row-major arrays of 6), homographies (9), rings of points.

Affines and homographies act on (row, col). Rings are arrays of structs x, y without a repeated last point.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

MERCATOR_R, EARTH_R = 6378137.0, 6371000.0


def mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(y, x) in metres of spherical Mercator."""
    return F.log(F.tan(F.lit(pi / 4) + F.radians(lat) / 2)) * MERCATOR_R, F.radians(lon) * MERCATOR_R


def mercator_inv(y: Column, x: Column) -> tuple[Column, Column]:
    """(lat, lon) in degrees."""
    return F.degrees(F.atan(F.exp(y / MERCATOR_R)) * 2 - F.lit(pi / 2)), F.degrees(x / MERCATOR_R)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    sine = lambda a, b: F.pow(F.sin((F.radians(b) - F.radians(a)) / 2), 2)
    a = sine(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * sine(lon1, lon2)
    return F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a)) * 2 * EARTH_R


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone of a point: 326zz north (the equator included), 327zz south."""
    zone = F.floor((lon + 180) / 6).cast("int") + 1
    return F.when(lat >= 0, zone + 32600).otherwise(zone + 32700)


def apply_homography(h: Column, r: Column, c: Column) -> tuple[Column, Column]:
    """(row, col) under h; the divisor is z + 1e-7."""
    z = h[6] * r + h[7] * c + h[8] + 1e-7
    return (h[0] * r + h[1] * c + h[2]) / z, (h[3] * r + h[4] * c + h[5]) / z


def homography_inv(h: Column) -> Column:
    """The inverse of a homography up to scale, by cofactors, scaled to the inverse proper; null where it is singular."""
    m = lambda a, b, c, d: h[a] * h[d] - h[b] * h[c]
    cofactors = (m(4, 5, 7, 8), m(2, 1, 8, 7), m(1, 2, 4, 5), m(5, 3, 8, 6), m(0, 2, 6, 8), m(2, 0, 5, 3), m(3, 4, 6, 7), m(1, 0, 7, 6), m(0, 1, 3, 4))
    det = h[0] * cofactors[0] + h[1] * cofactors[3] + h[2] * cofactors[6]
    return F.when(det != 0, F.array(*(F.try_divide(x, det) for x in cofactors)))


def affine_apply(m: Column, r: Column, c: Column) -> tuple[Column, Column]:
    return m[0] * r + m[1] * c + m[2], m[3] * r + m[4] * c + m[5]


def affine_compose(b: Column, a: Column) -> Column:
    """b after a."""
    return F.array(
        b[0] * a[0] + b[1] * a[3], b[0] * a[1] + b[1] * a[4], b[0] * a[2] + b[1] * a[5] + b[2],
        b[3] * a[0] + b[4] * a[3], b[3] * a[1] + b[4] * a[4], b[3] * a[2] + b[4] * a[5] + b[5],
    )


def affine_inv(m: Column) -> Column:
    """The inverse; null where the matrix is singular."""
    d = m[0] * m[4] - m[1] * m[3]
    i = [F.try_divide(x, d) for x in (m[4], -m[1], -m[3], m[0])]
    return F.when(d != 0, F.array(i[0], i[1], -(i[0] * m[2] + i[1] * m[5]), i[2], i[3], -(i[2] * m[2] + i[3] * m[5])))


def affine_swap(m: Column) -> Column:
    """Between (x, y) and (row, col): rows and columns change places."""
    return F.array(m[4], m[3], m[5], m[1], m[0], m[2])


def affine_local_to_global(m: Column, r: Column, c: Column) -> Column:
    """An affine about the centre (r, c) as one about the origin: t = t_local + (I - A) centre."""
    return F.array(m[0], m[1], m[2] + r - (m[0] * r + m[1] * c), m[3], m[4], m[5] + c - (m[3] * r + m[4] * c))


def affine_from_offsets(p: Column) -> Column:
    """Six correction parameters (line: constant, by samp, by line; samp: the same) as the affine (line, samp) - offset."""
    return F.array(F.lit(1.0) - p[2], -p[1], -p[0], -p[5], F.lit(1.0) - p[4], -p[3])


def _edges(ring: Column) -> Column:
    """Structs a, b of each point and the next."""
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(F.size(ring), F.lit(1))), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _cross(e: Column) -> Column:
    return e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]


def polygon_area(ring: Column) -> Column:
    """Signed area, positive if counter-clockwise; 0 for fewer than three points."""
    total = F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + _cross(e))
    return F.when(F.size(ring) < 3, 0.0).otherwise(total / 2)


def polygon_centroid(ring: Column) -> Column:
    """Struct x, y; the mean of the points where the area is 0."""
    area = polygon_area(ring)
    part = lambda k: F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + (e["a"][k] + e["b"][k]) * _cross(e))
    mean = lambda k: F.try_divide(F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[k]), F.size(ring))
    return F.struct(*(F.when(area == 0, mean(k)).otherwise(F.try_divide(part(k), area * 6)).alias(k) for k in ("x", "y")))


def polygon_ccw(ring: Column) -> Column:
    """The ring in counter-clockwise order."""
    return F.when(polygon_area(ring) < 0, F.reverse(ring)).otherwise(ring)


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Ring of a rectangle: (x0,y0), (x1,y0), (x1,y1), (x0,y1)."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def window_corners(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Corners tl, tr, br, bl of a window given by its diagonal."""
    return rectangle(x0, y0, x1, y1)


def window_extent(h: Column, size: int) -> Column:
    """The larger of the row and column spans that a size x size window covers under the homography h."""
    at = [apply_homography(h, F.lit(float(r)), F.lit(float(c))) for r, c in ((0, 0), (0, size), (size, size), (size, 0))]
    span = lambda k: F.greatest(*(p[k] for p in at)) - F.least(*(p[k] for p in at))
    return F.greatest(span(0), span(1))


def gray(r: Column, g: Column, b: Column) -> Column:
    return (r * 0.299 + g * 0.587 + b * 0.114).cast("int")


def l2_normalize(v: Column) -> Column:
    """Unit vector of doubles; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-12)))
