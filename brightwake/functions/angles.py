"""Angles and compass points."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names of the 16 points in English and French.
POINTS_EN = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]
POINTS_FR = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSO", "SO", "OSO", "O", "ONO", "NO", "NNO"]


def pmod(a: Column, n: float) -> Column:
    """The remainder with the sign of ``n``, as for courses; ``%`` keeps the sign of ``a``."""
    return F.pmod(a, F.lit(n))


def atan2(y: Column, x: Column) -> Column:
    """The angle of (x, y), with pi where y is 0 and x is -0.0, which Spark's own takes for 0.0; y's own sign is not told apart there."""
    return F.when((y == 0) & (x == 0) & x.cast("string").startswith("-"), F.lit(math.pi)).otherwise(F.atan2(y, x))


def degrees_signed(rad: Column) -> Column:
    """Degrees with the sign of the angle kept."""
    return (rad * 180 / math.pi) % 360


def course(rad: Column) -> Column:
    """Degrees from 0 up to 360."""
    return pmod(F.degrees(rad), 360.0)


def compass(deg: Column, points: list[str] = POINTS_EN, missing: str | None = None) -> Column:
    """The nearest of 16 points; ties go up."""
    names = F.array(*map(F.lit, points))
    return F.coalesce(F.get(names, pmod(F.floor(deg / 22.5 + 0.5), 16).cast("int")), F.lit(missing))


def difference(a: Column, b: Column) -> Column:
    """a - b on the circle, from -180 up to 180."""
    return pmod(a - b + 540, 360.0) - 180


def fold_pi(rad: Column) -> Column:
    return pmod(rad + math.pi, 2 * math.pi) - math.pi


def fold_180(deg: Column) -> Column:
    """An angle between two courses, 0 to 180."""
    a = F.abs(deg)
    return F.least(a, 360 - a)


def circular_mean(deg: Column) -> Column:
    """An aggregate: the mean direction, 0 up to 360; null without values."""
    return pmod(F.degrees(F.atan2(F.avg(F.sin(F.radians(deg))), F.avg(F.cos(F.radians(deg))))), 360.0)


def circular_spread(deg: Column) -> Column:
    """An aggregate: the circular standard deviation in degrees."""
    length = F.sqrt(F.pow(F.avg(F.sin(F.radians(deg))), 2) + F.pow(F.avg(F.cos(F.radians(deg))), 2))
    return F.degrees(F.sqrt(-2 * F.log(F.least(F.lit(1.0), F.greatest(length, F.lit(1e-12))))))


def mounted(value: Column, offset: Column, reverse: Column) -> Column:
    """A sensor's angle after its mounting's sign and offset."""
    return F.when(reverse, -value).otherwise(value) + offset
