"""Geodesy and planar geometry as column expressions (whole-stage codegen, no UDF)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean earth radius and the ellipsoid of the shifted map datum.
EARTH_KM = 6371.0088
MERCATOR_M = 6378137.0
GCJ_A = 6378245.0
GCJ_EE = 0.00669342162296594323


def _d(x: float) -> Column:
    return F.lit(float(x))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance, arcsine form."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return _d(2 * EARTH_KM) * F.asin(F.sqrt(a))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres, arctangent form."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return _d(2 * EARTH_KM * 1000) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def mercator_to_wgs84(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude of spherical Mercator metres."""
    return F.degrees(x / _d(MERCATOR_M)), F.degrees(2 * F.atan(F.exp(y / _d(MERCATOR_M))) - F.pi() / 2)


def wgs84_to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * _d(MERCATOR_M), F.log(F.tan(F.pi() / 4 + F.radians(lat) / 2)) * _d(MERCATOR_M)


def outside_china(lon: Column, lat: Column) -> Column:
    return (lon < _d(72.004)) | (lon > _d(137.8347)) | (lat < _d(0.8293)) | (lat > _d(55.8271))


# The coefficients of the published GCJ-02 shift, here and in the two functions below.
def _wave(x: Column, *terms: tuple[float, float]) -> Column:
    out = F.lit(0.0)
    for factor, period in terms:
        out = out + _d(factor) * F.sin(x * F.pi() / _d(period))
    return out * _d(2.0 / 3.0)


def wgs84_to_gcj02(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Shifted longitude and latitude; the same point outside China."""
    x, y = lon - 105.0, lat - 35.0
    ripple = _wave(x, (20.0, 1 / 6.0), (20.0, 0.5))
    dlat = _d(-100.0) + _d(2.0) * x + _d(3.0) * y + _d(0.2) * y * y + _d(0.1) * x * y + _d(0.2) * F.sqrt(F.abs(x)) + ripple
    dlat = dlat + _wave(y, (20.0, 1.0), (40.0, 3.0)) + _wave(y, (160.0, 12.0), (320.0, 30.0))
    dlon = _d(300.0) + x + _d(2.0) * y + _d(0.1) * x * x + _d(0.1) * x * y + _d(0.1) * F.sqrt(F.abs(x)) + ripple
    dlon = dlon + _wave(x, (20.0, 1.0), (40.0, 3.0)) + _wave(x, (150.0, 12.0), (300.0, 30.0))
    rad = F.radians(lat)
    magic = _d(1.0) - _d(GCJ_EE) * F.sin(rad) * F.sin(rad)
    root = F.sqrt(magic)
    dlat = dlat * 180.0 / (_d(GCJ_A * (1 - GCJ_EE)) / (magic * root) * F.pi())
    dlon = dlon * 180.0 / (_d(GCJ_A) / root * F.cos(rad) * F.pi())
    out = outside_china(lon, lat)
    return F.when(out, lon).otherwise(lon + dlon), F.when(out, lat).otherwise(lat + dlat)


def gcj02_to_wgs84(lon: Column, lat: Column) -> tuple[Column, Column]:
    """One-step inverse: the shift at the shifted point is taken off."""
    a, b = wgs84_to_gcj02(lon, lat)
    return lon * 2 - a, lat * 2 - b


def projection_fraction(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Share of segment a-b at which the point is nearest, clamped; 0 for a point-like segment."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = ((px - ax) * dx + (py - ay) * dy) / F.when(size > 0, size)
    return F.coalesce(F.greatest(_d(0.0), F.least(_d(1.0), t)), _d(0.0))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Planar distance of a point from a segment."""
    t = projection_fraction(px, py, ax, ay, bx, by)
    x, y = ax + t * (bx - ax), ay + t * (by - ay)
    return F.sqrt((px - x) * (px - x) + (py - y) * (py - y))


def in_ring(lon: Column, lat: Column, ring: list[tuple[float, float]]) -> Column:
    """Half-open ray cast: a point on a border belongs to one side only."""
    crossings = F.lit(0)
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if ay != by:
            x = _d(ax) + (lat - _d(ay)) * _d(bx - ax) / _d(by - ay)
            crossings = crossings + F.when(((_d(ay) > lat) != (_d(by) > lat)) & (lon < x), 1).otherwise(0)
    return crossings % 2 == 1


def on_ring(lon: Column, lat: Column, ring: list[tuple[float, float]], tolerance: float = 1e-12) -> Column:
    out = F.lit(False)
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
        out = out | (segment_distance(lon, lat, _d(ax), _d(ay), _d(bx), _d(by)) <= _d(tolerance))
    return out


def covers(lon: Column, lat: Column, polygons: list[list[list[tuple[float, float]]]]) -> Column:
    """Whether any polygon (outer ring, then holes) covers the point; borders count as inside."""
    out = F.lit(False)
    for outer, *holes in polygons:
        inside = in_ring(lon, lat, outer) | on_ring(lon, lat, outer)
        for h in holes:
            inside = inside & (~in_ring(lon, lat, h) | on_ring(lon, lat, h))
        out = out | inside
    return out


def degrees_of(km: float) -> float:
    """Latitude degrees that surely span this distance."""
    return math.degrees(km / EARTH_KM) * 1.000001
