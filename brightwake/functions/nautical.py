"""Boat and water motion, calibrations and times."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .angles import atan2, difference, fold_180, pmod


def current_east(sog: Column, cog: Column, stw: Column, hdg: Column) -> Column:
    return sog * F.sin(cog) - stw * F.sin(hdg)


def current_north(sog: Column, cog: Column, stw: Column, hdg: Column) -> Column:
    return sog * F.cos(cog) - stw * F.cos(hdg)


def current_drift(sog: Column, cog: Column, stw: Column, hdg: Column) -> Column:
    """Speed of the water over the ground; angles in radians."""
    e, n = current_east(sog, cog, stw, hdg), current_north(sog, cog, stw, hdg)
    return F.sqrt(e * e + n * n)


def current_set(sog: Column, cog: Column, stw: Column, hdg: Column) -> Column:
    """Where the water goes, 0 up to two pi; as ever with atan2, what is 0 keeps the direction that its sign tells."""
    return pmod(atan2(current_east(sog, cog, stw, hdg), current_north(sog, cog, stw, hdg)), 2 * math.pi)


def leeway(cog_deg: Column, heading_deg: Column) -> Column:
    return difference(cog_deg, heading_deg)


def vmg_to_mark(sog: Column, cog: Column, mark_bearing: Column) -> Column:
    return sog * F.cos(F.radians(fold_180(cog - mark_bearing)))


def vmg_to_wind(stw: Column, twa: Column) -> Column:
    return stw * F.cos(twa)


def rated_vmg(vmg: Column, rating: Column, own_rating: float = 156.0) -> Column:
    """Corrected by handicap; null without a rating."""
    return vmg * (F.lit(own_rating) / F.nullif(rating.cast("double"), F.lit(0.0)))


def time_to_mark(distance: Column, sog: Column) -> Column:
    return distance / F.greatest(sog, F.lit(0.1))


def calibrated(raw: Column, offset: float, factor: float) -> Column:
    return (raw - offset) * factor


def polynomial(raw: Column, coefficients: list[float]) -> Column:
    """The sum of c_i * raw ** i."""
    total = F.lit(0.0)
    for c in reversed(coefficients):
        total = total * raw + c
    return total


def vertical_acceleration(ax: Column, ay: Column, az: Column, roll: Column, pitch: Column) -> Column:
    return -ax * F.sin(pitch) + ay * F.sin(roll) * F.cos(pitch) + az * F.cos(roll) * F.cos(pitch)


def fatigue(current: Column, baseline: Column) -> Column:
    """Loss of speed against the baseline, in percent."""
    return 100 * (1 - current / F.nullif(baseline, F.lit(0.0)))


def synced_timer(seconds: Column) -> Column:
    """A countdown moved to the nearest full minute; half a minute goes down; never below 0."""
    rest = pmod(seconds, 60)
    return F.greatest(F.when(rest <= 30, seconds - rest).otherwise(seconds + 60 - rest), F.lit(0))


def clock(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on."""
    s = F.abs(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))
