"""Unit conversions, and the registry of display units by measurement.

Several factors stand for the same unit in the figures that users compare with, so each keeps its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (measurement, factor, offset, unit, kind).
DISPLAY_UNITS = [
    ("navigation.speedOverGround", 1.94384, 0.0, "knots", "speed"),
    ("navigation.speedThroughWater", 1.94384, 0.0, "knots", "speed"),
    ("environment.wind.speedTrue", 1.94384, 0.0, "knots", "speed"),
    ("environment.wind.speedApparent", 1.94384, 0.0, "knots", "speed"),
    ("performance.velocityMadeGood", 1.94384, 0.0, "knots", "speed"),
    ("performance.current.speed", 1.94384, 0.0, "knots", "speed"),
    ("navigation.attitude.roll", 57.2958, 0.0, "degree", "angle"),
    ("navigation.attitude.pitch", 57.2958, 0.0, "degree", "angle"),
    ("navigation.attitude.yaw", 57.2958, 0.0, "degree", "angle"),
    ("navigation.headingTrue", 57.2958, 0.0, "degree", "angle"),
    ("navigation.headingMagnetic", 57.2958, 0.0, "degree", "angle"),
    ("navigation.courseOverGroundTrue", 57.2958, 0.0, "degree", "angle"),
    ("environment.wind.directionTrue", 57.2958, 0.0, "degree", "angle"),
    ("environment.wind.directionMagnetic", 57.2958, 0.0, "degree", "angle"),
    ("environment.wind.angleApparent", 57.2958, 0.0, "degree", "angle"),
    ("environment.wind.angleTrueWater", 57.2958, 0.0, "degree", "angle"),
    ("environment.water.temperature", 1.0, -273.15, "celsius", "temp"),
    ("environment.outside.temperature", 1.0, -273.15, "celsius", "temp"),
    ("environment.outside.pressure", 0.01, 0.0, "hPa", "pressure"),
]


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DISPLAY_UNITS, "measurement string, factor double, offset double, unit string, kind string")


def in_display_units(points: DataFrame) -> DataFrame:
    """Each point's value converted once by the registry; measurements that it lacks keep their values."""
    units = F.broadcast(registry(points.sparkSession))
    shown = F.col("value_double") * F.coalesce("factor", F.lit(1.0)) + F.coalesce("offset", F.lit(0.0))
    return points.join(units, "measurement", "left").withColumn("display_value", shown)


def knots(ms: Column) -> Column:
    return ms * 1.94384


def knots_by_division(ms: Column) -> Column:
    return ms / 0.51444


def knots_short(ms: Column) -> Column:
    return ms * 1.944


def knots_from_kmh(kmh: Column) -> Column:
    return kmh / 1.852


def celsius(kelvin: Column) -> Column:
    return kelvin - 273.15


def kelvin(celsius_value: Column) -> Column:
    return celsius_value + 273.15


def fahrenheit(celsius_value: Column) -> Column:
    return celsius_value * 9 / 5 + 32


def hectopascal(pascal: Column) -> Column:
    return pascal / 100


def percent(ratio: Column) -> Column:
    return ratio * 100


def feet(metres: Column) -> Column:
    return metres * 3.28084


def nautical_miles(metres: Column) -> Column:
    return metres / 1852


def degrees_per_minute(radians_per_second: Column) -> Column:
    return radians_per_second * 180 / 3.14159 * 60


def fixed(value: Column, digits: int) -> Column:
    """As text with so many digits; null stays null."""
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value.cast("double")))


def _beyond_tie(value: Column, digits: int) -> tuple[Column, Column]:
    """The whole multiples of 10^-digits at or below a size, and where it lies against the middle of the step: -1, 0 or 1.

    Decided on the double itself, not on its shortest decimal: 1.005 is a little less than a middle, 0.125 is one. The
    product's rounding error is found by splitting the factor into halves of 26 bits, so it decides exactly.
    """
    scale = float(10 ** (digits + 1))
    high = value * 134217729.0 - (value * 134217729.0 - value)
    tenths = F.floor(value * scale).cast("double")
    error = lambda whole: (high * scale - whole) + (value - high) * scale
    tenths = F.when(error(tenths) < 0, tenths - 1).when(error(tenths) >= 1, tenths + 1).otherwise(tenths)
    last = F.pmod(tenths, F.lit(10.0))
    side = F.when(last < 5, -1).when((last > 5) | (error(tenths) > 0), 1).otherwise(0)
    return F.floor(tenths / 10), side


def to_fixed(value: Column, digits: int) -> Column:
    """Text with so many digits (six at most), the middle away from zero, as scripts of web pages write it; null stays null.

    Sizes must stay below 2^53 / 10^(digits + 1); larger ones, NaN and infinity give null.
    """
    if not 0 <= digits <= 6:
        raise ValueError(f"{digits} digits")
    size = F.abs(value.cast("double"))
    below, side = _beyond_tie(size, digits)
    units = (below + F.when(side >= 0, 1).otherwise(0)).cast("long")
    whole = F.floor(units / 10**digits).cast("string") if digits else units.cast("string")
    text = F.concat(whole, F.lit("."), F.lpad((units % 10**digits).cast("string"), digits, "0")) if digits else whole
    return F.when(size < 2.0**53 / 10 ** (digits + 1), F.concat(F.when(value < 0, "-").otherwise(""), text))


def round_even(value: Column, digits: int) -> Column:
    """The number with so many digits (six at most), an exact middle to the even side, as Python rounds; bounds as :func:`to_fixed`."""
    if not 0 <= digits <= 6:
        raise ValueError(f"{digits} digits")
    size = F.abs(value.cast("double"))
    below, side = _beyond_tie(size, digits)
    up = (side > 0) | ((side == 0) & (below % 2 == 1))
    units = (below + F.when(up, 1).otherwise(0)).cast("double")
    return F.when(size < 2.0**53 / 10 ** (digits + 1), units / float(10**digits) * F.when(value < 0, -1.0).otherwise(1.0))


def rounded(value: Column, digits: int) -> Column:
    """As ``F.round`` of a double, which goes by its decimal text and takes long; here only close to a middle and for large values."""
    scaled = value * 10.0**digits
    plain = (F.abs(scaled - F.rint(scaled)) < 0.499999) & (F.abs(scaled) < 1e9)
    return F.when(plain, F.rint(scaled) / 10.0**digits + 0.0).otherwise(F.round(value, digits))


def with_units(df: DataFrame, units: dict[str, str]) -> DataFrame:
    """Columns with their display unit as metadata: the first of ``units`` (word of a name, unit) whose word a name has."""
    for name in df.columns:
        if (unit := next((u for word, u in units.items() if word.lower() in name.lower()), None)) is not None:
            df = df.withMetadata(name, df.schema[name].metadata | {"unit": unit})
    return df


def day_stamp(time: Column) -> Column:
    """The day as eight digits."""
    return F.date_format(time, "yyyyMMdd")


def underscored(text: Column) -> Column:
    """Blanks as underscores, for names that may hold none."""
    return F.replace(text, F.lit(" "), F.lit("_"))
