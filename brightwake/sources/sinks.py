"""Sinks: text forms of points and results, and the files that hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .feeds import checksum


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([ ,=])", r"\\$1")


def as_line_protocol(points: DataFrame) -> DataFrame:
    """One line for each point with a value; blanks in names are escaped, strings quoted."""
    tags = F.array_join(F.transform(F.array_sort(F.map_entries(F.coalesce("tags", F.create_map().cast("map<string,string>")))), lambda e: F.concat(F.lit(","), escaped(e["key"]), F.lit("="), escaped(e["value"]))), "")
    value = F.coalesce(F.col("value_double").cast("string"), F.col("value_boolean").cast("string"), F.concat(F.lit('"'), F.regexp_replace("value_string", '(["\\\\])', "\\\\$1"), F.lit('"')))
    stamp = (F.unix_micros("time") * 1000).cast("string")
    return points.filter(value.isNotNull()).select(F.concat(escaped(F.col("measurement")), tags, F.lit(" "), escaped(F.col("field")), F.lit("="), value, F.lit(" "), stamp).alias("line"))


def as_deltas(values: DataFrame, by: list[str], label: str) -> DataFrame:
    """(path, value, time) rows as hub updates, one document for each group."""
    items = F.array_sort(F.collect_list(F.struct("path", "value")))
    out = values.groupBy(*by).agg(F.max("time").alias("time"), items.alias("values"))
    update = F.struct(F.struct(F.lit(label).alias("label")).alias("source"), F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), F.col("values"))
    return out.select(*by, F.to_json(F.struct(F.lit("vessels.self").alias("context"), F.array(update).alias("updates"))).alias("delta"))


def as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text, as tool replies are."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def sentence(kind: str, *cells: Column) -> Column:
    """$kind,cells*checksum."""
    body = F.concat_ws(",", F.lit(kind), *(F.coalesce(c.cast("string"), F.lit("")) for c in cells))
    return F.concat(F.lit("$"), body, F.lit("*"), checksum(body))


def heading_sentence(deg: Column) -> Column:
    return sentence("IIHDT", F.format_string("%.1f", deg), F.lit("T"))


def wind_sentence(deg: Column, knots: Column, true: bool) -> Column:
    return sentence("IIMWV", F.format_string("%.1f", deg), F.lit("T" if true else "R"), F.format_string("%.1f", knots), F.lit("N"), F.lit("A"))


def speed_sentence(deg: Column, knots: Column) -> Column:
    return sentence("IIVHW", F.format_string("%.1f", deg), F.lit("T"), F.lit(""), F.lit("M"), F.format_string("%.1f", knots), F.lit("N"), F.lit(""), F.lit("K"))


def coordinate(deg: Column, width: int) -> Column:
    """Degrees in ``width`` digits and minutes with four decimals, rounded together, so that no minute is 60."""
    minutes = F.round(F.abs(deg) * 60, 4)
    whole = F.floor(minutes / 60)
    return F.format_string(f"%0{width}d%07.4f", whole, F.round(minutes - whole * 60, 4))


def _place(lat: Column, lon: Column) -> list[Column]:
    return [coordinate(lat, 2), F.when(lat < 0, "S").otherwise("N"), coordinate(lon, 3), F.when(lon < 0, "W").otherwise("E")]


def fix_sentence(time: Column, lat: Column, lon: Column, satellites: Column) -> Column:
    """GGA: time, place, quality 1, satellites; null without a place."""
    blank = F.lit("")
    made = sentence("IIGGA", F.date_format(time, "HHmmss"), *_place(lat, lon), F.lit("1"), F.format_string("%02d", satellites), blank, blank, F.lit("M"), blank, F.lit("M"), blank, blank)
    return F.when(lat.isNotNull() & lon.isNotNull(), made)


def course_sentence(time: Column, lat: Column, lon: Column, knots: Column, deg: Column) -> Column:
    """RMC: time, place, speed and course over ground, date; null without a place."""
    number = lambda c: F.when(c.isNotNull(), F.format_string("%.1f", c))
    made = sentence("IIRMC", F.date_format(time, "HHmmss"), F.lit("A"), *_place(lat, lon), number(knots), number(deg), F.date_format(time, "ddMMyy"), F.lit(""), F.lit(""))
    return F.when(lat.isNotNull() & lon.isNotNull(), made)


def wind_direction_sentence(deg: Column, knots: Column) -> Column:
    """MWD: true wind direction, and its speed in knots and metres a second."""
    return sentence("IIMWD", F.format_string("%.1f", deg), F.lit("T"), F.lit(""), F.lit("M"), F.format_string("%.1f", knots), F.lit("N"), F.format_string("%.1f", knots / 1.94384), F.lit("M"))


def export_csv(points: DataFrame, path: str, keys: list[str], order: str) -> None:
    """A header and rows grouped by ``keys``, sorted within each group."""
    points.repartition(*keys).sortWithinPartitions(*keys, order).write.mode("overwrite").option("header", True).csv(path)


def retained(points: DataFrame, asof: Column, keep: str, time: str = "time") -> DataFrame:
    """What a retention of ``keep`` leaves."""
    return points.filter(F.col(time) >= asof - F.expr(f"interval {keep}"))
