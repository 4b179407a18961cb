"""Sun and moon from published formulas: the sun's times to a few minutes, the moon's to about one."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400.0
#: Days from the epoch of the formulas (2000-01-01 12:00) to the Unix epoch.
J2000 = 10957.5


def days(t: Column) -> Column:
    return t.cast("double") / DAY - J2000


def declination(d: Column) -> Column:
    """The sun's, in radians."""
    return F.asin(F.sin(_longitude(d)) * math.sin(math.radians(23.4397)))


def _anomaly(d: Column) -> Column:
    return F.radians(357.5291 + 0.98560028 * d)


def _longitude(d: Column) -> Column:
    m = _anomaly(d)
    return m + F.radians(1.9148 * F.sin(m) + 0.02 * F.sin(2 * m) + 0.0003 * F.sin(3 * m)) + math.radians(102.9372 + 180)


def _transit(t: Column, lon: Column) -> Column:
    """The day's noon at a longitude, in days from the formulas' epoch."""
    west = -lon / 360
    cycle = F.round(days(t) - 0.0009 - west)
    near = 0.0009 + west + cycle
    return near + 0.0053 * F.sin(_anomaly(near)) - 0.0069 * F.sin(2 * _longitude(near))


def _stamp(d: Column) -> Column:
    return F.timestamp_seconds((d + J2000) * DAY)


def noon(t: Column, lon: Column) -> Column:
    return _stamp(_transit(t, lon))


def _half_day(t: Column, lat: Column, lon: Column, altitude: float) -> Column:
    dec, phi = declination(_transit(t, lon)), F.radians(lat)
    x = (math.sin(math.radians(altitude)) - F.sin(phi) * F.sin(dec)) / (F.cos(phi) * F.cos(dec))
    return F.when(F.abs(x) <= 1, F.acos(x) / (2 * math.pi))


def sunrise(t: Column, lat: Column, lon: Column, altitude: float = -0.833) -> Column:
    """Of the day nearest ``t``; null where the sun stays up or down. -12 degrees is nautical twilight."""
    return _stamp(_transit(t, lon) - _half_day(t, lat, lon, altitude))


def sunset(t: Column, lat: Column, lon: Column, altitude: float = -0.833) -> Column:
    return _stamp(_transit(t, lon) + _half_day(t, lat, lon, altitude))


def minutes_to(event: Column, asof: Column) -> Column:
    return (event.cast("double") - asof.cast("double")) / 60


# ---- the moon, by the largest terms of its published series

# Degrees (or kilometres) and the multiples of elongation, sun's anomaly, moon's anomaly and latitude argument.
_LONGITUDE = [(6.288774, 0, 0, 1, 0), (1.274027, 2, 0, -1, 0), (0.658314, 2, 0, 0, 0), (0.213618, 0, 0, 2, 0), (-0.185116, 0, 1, 0, 0), (-0.114332, 0, 0, 0, 2), (0.058793, 2, 0, -2, 0), (0.057066, 2, -1, -1, 0), (0.053322, 2, 0, 1, 0), (0.045758, 2, -1, 0, 0)]
_LATITUDE = [(5.128122, 0, 0, 0, 1), (0.280602, 0, 0, 1, 1), (0.277693, 0, 0, 1, -1), (0.173237, 2, 0, 0, -1), (0.055413, 2, 0, -1, 1), (0.046271, 2, 0, -1, -1)]
_DISTANCE = [(-20905.355, 0, 0, 1, 0), (-3699.111, 2, 0, -1, 0), (-2955.968, 2, 0, 0, 0), (-569.925, 0, 0, 2, 0)]
_OBLIQUITY = math.radians(23.4393)


def _terms(d: Column, terms: list[tuple], fn) -> Column:
    own = [F.radians(a + b * d) for a, b in ((297.8501921, 12.19074911), (357.5291092, 0.98560028), (134.9633964, 13.06499295), (93.2720950, 13.22935024))]
    parts = []
    for size, *times in terms:
        angle = sum((n * x for n, x in zip(times, own, strict=True) if n), F.lit(0.0))
        parts.append(size * fn(angle))
    return sum(parts[1:], parts[0])


def moon_position(d: Column) -> tuple[Column, Column, Column]:
    """Longitude and latitude in degrees, and distance in kilometres, ``d`` days after the formulas' epoch."""
    return F.pmod(218.3164477 + 13.17639648 * d + _terms(d, _LONGITUDE, F.sin), F.lit(360.0)), _terms(d, _LATITUDE, F.sin), 385000.56 + _terms(d, _DISTANCE, F.cos)


def _above(d: Column, lat: Column, lon: Column) -> Column:
    """Degrees by which the moon's upper edge stands over the horizon, with refraction and parallax."""
    longitude, latitude, distance = moon_position(d)
    x, y = F.radians(longitude), F.radians(latitude)
    ascension = F.atan2(F.sin(x) * math.cos(_OBLIQUITY) - F.tan(y) * math.sin(_OBLIQUITY), F.cos(x))
    sine = F.sin(y) * math.cos(_OBLIQUITY) + F.cos(y) * math.sin(_OBLIQUITY) * F.sin(x)
    hour = F.radians(F.pmod(280.46061837 + 360.98564737 * d + lon, F.lit(360.0))) - ascension
    phi = F.radians(lat)
    altitude = F.degrees(F.asin(F.sin(phi) * sine + F.cos(phi) * F.sqrt(1 - sine * sine) * F.cos(hour)))
    return altitude - (0.7275 * F.degrees(F.asin(6378.14 / distance)) - 0.5667)


def _moon_turn(day: Column, lat: Column, lon: Column, up: bool) -> Column:
    """The first time in the 24 hours from ``day`` at which the moon comes up (or goes down); null if it doesn't.

    The hour in which the sign changes is halved twelve times, which leaves less than a second.
    """
    start = days(day.cast("timestamp"))
    side = lambda d: (_above(d, lat, lon) > 0) == F.lit(up)
    hours = F.transform(F.sequence(F.lit(0), F.lit(24)), lambda h: F.struct(h.alias("h"), side(start + h / 24).alias("on")))
    turns = F.filter(F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.when(~F.get(hours, h)["on"] & F.get(hours, h + 1)["on"], h)), lambda h: h.isNotNull())
    first = F.get(turns, F.lit(0))
    halve = lambda acc, k: F.when(side(start + (acc + F.pow(F.lit(0.5), k)) / 24), acc).otherwise(acc + F.pow(F.lit(0.5), k))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(12)), first.cast("double"), halve)
    return F.when(first.isNotNull(), _stamp(start + found / 24))


def moonrise(day: Column, lat: Column, lon: Column) -> Column:
    """Of the day that begins at ``day``; null where the moon doesn't rise in it."""
    return _moon_turn(day, lat, lon, True)


def moonset(day: Column, lat: Column, lon: Column) -> Column:
    return _moon_turn(day, lat, lon, False)


def moon_phase(t: Column) -> Column:
    """0 new, 0.25 first quarter, 0.5 full, up to 1: how far the moon is ahead of the sun."""
    d = days(t)
    return F.pmod((moon_position(d)[0] - F.degrees(_longitude(d))) / 360, F.lit(1.0))


def moon_illumination(t: Column) -> Column:
    return (1 - F.cos(2 * math.pi * moon_phase(t))) / 2
