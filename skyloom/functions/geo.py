"""Geodesy as Column expressions (F3-F8).  Built-ins only, so they stay in codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from skyloom.constants import EARTH_RADIUS_KM, KM_PER_DEG_LAT, KM_PER_DEG_LON_EQUATOR


def _within(value: Column, low: float, high: float) -> Column:
    """Clamp that keeps NULL NULL (``least`` and ``greatest`` skip NULLs)."""
    return F.when(value > high, F.lit(high)).when(value < low, F.lit(low)).otherwise(value)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """great-circle distance in km; the root is clamped to 1 for antipodes."""
    north = F.sin(F.radians(lat2 - lat1) / 2)
    east = F.sin(F.radians(lon2 - lon1) / 2)
    chord = north * north + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * east * east
    return F.asin(_within(F.sqrt(chord), 0.0, 1.0)) * (2 * EARTH_RADIUS_KM)


def compass(x: Column, y: Column) -> Column:
    """direction of the vector (x east, y north) in degrees, 0-360."""
    return F.pmod(F.degrees(F.atan2(x, y)) + 360.0, F.lit(360.0))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """initial bearing from point 1 to point 2 in degrees, 0-360."""
    a, b, dlon = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return compass(
        F.sin(dlon) * F.cos(b),
        F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(dlon),
    )


def destination(lat: Column, lon: Column, bearing: Column, km: Column) -> tuple[Column, Column]:
    """(lat, lon) reached after ``km`` along ``bearing``; lon wraps to [-180, 180)."""
    a, course, arc = F.radians(lat), F.radians(bearing), km / EARTH_RADIUS_KM
    sin_end = F.sin(a) * F.cos(arc) + F.cos(a) * F.sin(arc) * F.cos(course)
    sin_end = _within(sin_end, -1.0, 1.0)
    turn = F.atan2(F.sin(course) * F.sin(arc) * F.cos(a), F.cos(arc) - F.sin(a) * sin_end)
    return (
        F.degrees(F.asin(sin_end)),
        F.pmod(lon + F.degrees(turn) + 540.0, F.lit(360.0)) - 180.0,
    )


def km_offset(origin_lat: Column, origin_lon: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """flat-earth (east, north) offset in km from a radar site."""
    east = (lon - origin_lon) * KM_PER_DEG_LON_EQUATOR * F.cos(F.radians(origin_lat))
    return east, (lat - origin_lat) * KM_PER_DEG_LAT


def grid_position(km: Column, grid_km: Column, n: Column) -> Column:
    """Fractional cell index of an offset on an n-cell axis spanning +-grid_km."""
    return (km + grid_km) / (grid_km * 2) * (n - 1)


def clamp_index(position: Column, n: Column) -> Column:
    """F8: nearest cell (half to even), kept inside the grid."""
    cell = F.rint(position).cast("int")
    last = n.cast("int") - 1
    return F.when(cell < 0, F.lit(0)).when(cell > last, last).otherwise(cell)
