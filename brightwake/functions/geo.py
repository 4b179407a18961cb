"""Great-circle and local-plane geometry. Positions are degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .angles import difference, pmod

EARTH_KM, EARTH_M, EARTH_NM = 6371.0, 6371000.0, 3440.065
METRES_PER_DEGREE = 111319.9


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_M) -> Column:
    """Haversine distance in the unit of ``radius``."""
    half = lambda x: F.sin(F.radians(x) / 2)
    a = half(lat2 - lat1) * half(lat2 - lat1) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon2 - lon1) * half(lon2 - lon1)
    return 2 * radius * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing, 0 up to 360."""
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return pmod(F.degrees(F.atan2(y, x)) + 360, 360.0)


def lateral_offset(lat: Column, lon: Column, own_lat: Column, own_lon: Column, axis: Column) -> Column:
    """Signed miles off the axis through the own position; positive to the right."""
    away = difference(bearing(own_lat, own_lon, lat, lon), axis)
    return distance(own_lat, own_lon, lat, lon, EARTH_NM) * F.sin(F.radians(away))


def line_side(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column, lat: Column, lon: Column) -> Column:
    """Signed metres from the line through A and B in the local plane; 0 if A and B are one point."""
    scale = METRES_PER_DEGREE * F.cos(F.radians((lat_a + lat_b) / 2))
    bx, by = (lon_b - lon_a) * scale, (lat_b - lat_a) * METRES_PER_DEGREE
    px, py = (lon - lon_a) * scale, (lat - lat_a) * METRES_PER_DEGREE
    length = F.sqrt(bx * bx + by * by)
    return F.when(length == 0, 0.0).otherwise((bx * py - by * px) / length)
