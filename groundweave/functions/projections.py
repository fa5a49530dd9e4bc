"""Map projections in NumPy, on batches of points: geographic, spherical Mercator and transverse Mercator systems by descriptor.

A descriptor is the row of a table of coordinate systems: epsg, kind (geographic, mercator, transverse), unit (its name), unit_m
(metres of a unit; 1 for degrees), lon0, scale, east0, north0 (of transverse systems, in metres). The ellipsoid is WGS 84.
Transverse Mercator goes by the series in the third flattening up to its fourth power, which is good to well under a millimetre within a zone.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

A, F_ = 6378137.0, 1 / 298.257223563
_N = F_ / (2 - F_)
_E = np.sqrt(F_ * (2 - F_))
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Coefficients of the series by power of n from the first on: forward, inverse, conformal to geographic latitude. Fixed values.
_FORWARD = ((1 / 2, -2 / 3, 5 / 16, 41 / 180), (0, 13 / 48, -3 / 5, 557 / 1440), (0, 0, 61 / 240, -103 / 140), (0, 0, 0, 49561 / 161280))
_INVERSE = ((1 / 2, -2 / 3, 37 / 96, -1 / 360), (0, 1 / 48, 1 / 15, -437 / 1440), (0, 0, 17 / 480, -37 / 840), (0, 0, 0, 4397 / 161280))
_LATITUDE = ((2, -2 / 3, -2, 116 / 45), (0, 7 / 3, -8 / 5, -227 / 45), (0, 0, 56 / 15, -136 / 35), (0, 0, 0, 4279 / 630))
_ALPHA, _BETA, _DELTA = ([sum(c * _N ** (k + 1) for k, c in enumerate(row)) for row in rows] for rows in (_FORWARD, _INVERSE, _LATITUDE))


class Crs(NamedTuple):
    epsg: int
    kind: str
    unit: str = "metre"
    unit_m: float = 1.0
    lon0: float = 0.0
    scale: float = 1.0
    east0: float = 0.0
    north0: float = 0.0


SCHEMA = "epsg int, kind string, unit string, unit_m double, lon0 double, scale double, east0 double, north0 double"


def known_systems() -> list[Crs]:
    """Degrees, spherical Mercator and all UTM zones of both halves."""
    zones = [Crs(32600 + 100 * south + z, "transverse", "metre", 1.0, 6.0 * z - 183, 0.9996, 500_000.0, 10_000_000.0 * south) for south in (0, 1) for z in range(1, 61)]
    return [Crs(4326, "geographic", "degree"), Crs(3857, "mercator"), *zones]


def from_lonlat(crs: Crs, lon, lat) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) in the system's units."""
    lon, lat = np.asarray(lon, float), np.asarray(lat, float)
    if crs.kind == "geographic":
        return lon, lat
    if crs.kind == "mercator":
        return np.radians(lon) * A / crs.unit_m, np.log(np.tan(np.pi / 4 + np.radians(lat) / 2)) * A / crs.unit_m
    sine, along = np.sin(np.radians(lat)), np.radians((lon - crs.lon0 + 180) % 360 - 180)
    t = np.sinh(np.arctanh(sine) - _E * np.arctanh(_E * sine))
    xi, eta = np.arctan2(t, np.cos(along)), np.arctanh(np.sin(along) / np.sqrt(1 + t * t))
    north = xi + sum(a * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    east = eta + sum(a * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    return (crs.east0 + crs.scale * _RADIUS * east) / crs.unit_m, (crs.north0 + crs.scale * _RADIUS * north) / crs.unit_m


def to_lonlat(crs: Crs, x, y) -> tuple[np.ndarray, np.ndarray]:
    """(lon, lat) in degrees."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if crs.kind == "geographic":
        return x, y
    if crs.kind == "mercator":
        return np.degrees(x * crs.unit_m / A), np.degrees(2 * np.arctan(np.exp(y * crs.unit_m / A)) - np.pi / 2)
    xi, eta = (y * crs.unit_m - crs.north0) / (crs.scale * _RADIUS), (x * crs.unit_m - crs.east0) / (crs.scale * _RADIUS)
    north = xi - sum(b * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, b in enumerate(_BETA, 1))
    east = eta - sum(b * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, b in enumerate(_BETA, 1))
    chi = np.arcsin(np.sin(north) / np.cosh(east))
    lat = chi + sum(d * np.sin(2 * j * chi) for j, d in enumerate(_DELTA, 1))
    return crs.lon0 + np.degrees(np.arctan2(np.sinh(east), np.cos(north))), np.degrees(lat)


def between(a: Crs, b: Crs, x, y) -> tuple[np.ndarray, np.ndarray]:
    """Points of a in b."""
    return (np.asarray(x, float), np.asarray(y, float)) if a == b else from_lonlat(b, *to_lonlat(a, x, y))
