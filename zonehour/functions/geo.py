"""Distances and the state-plane projection, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float = 6371.0) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


#: Lambert conformal conic with two standard parallels on GRS80, in US feet (New York Long Island).
A, F_INV = 6378137.0, 298.257222101
E1 = math.sqrt(2 / F_INV - 1 / F_INV**2)
PHI1, PHI2, PHI0, LAM0 = (math.radians(x) for x in (41 + 2 / 60, 40 + 40 / 60, 40 + 10 / 60, -74.0))
FALSE_EAST, FOOT = 300000.0, 1200 / 3937


def _m(p: float) -> float:
    return math.cos(p) / math.sqrt(1 - (E1 * math.sin(p)) ** 2)


def _t(p: float) -> float:
    return math.tan(math.pi / 4 - p / 2) / ((1 - E1 * math.sin(p)) / (1 + E1 * math.sin(p))) ** (E1 / 2)


N = math.log(_m(PHI1) / _m(PHI2)) / math.log(_t(PHI1) / _t(PHI2))
SCALE = A * _m(PHI1) / (N * _t(PHI1) ** N)
RHO0 = SCALE * _t(PHI0) ** N


def to_epsg2263(lat: Column, lng: Column) -> tuple[Column, Column]:
    """Easting and northing in feet of WGS84 degrees."""
    p = F.radians(lat)
    s = E1 * F.sin(p)
    t = F.tan(math.pi / 4 - p / 2) / F.pow((1 - s) / (1 + s), F.lit(E1 / 2))
    rho = SCALE * F.pow(t, F.lit(N))
    theta = N * (F.radians(lng) - LAM0)
    return (FALSE_EAST + rho * F.sin(theta)) / FOOT, (RHO0 - rho * F.cos(theta)) / FOOT


def micro(c: Column) -> Column:
    """Degrees as whole millionths, a key that equal coordinates share; NULL for NaN and infinity."""
    return F.round(c * 1_000_000).try_cast("long")
