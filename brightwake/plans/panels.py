"""Dashboard panels as data, and one scan for all panels that show a latest value.

A panel is a measurement (and field), a shape, and the factor of its display unit, applied once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightwake.operators.series import Series

KNOTS, DEGREES, DEGREES_LONG, DEGREES_SHORT = 1.94384, 57.2958, 180.0 / 3.14159265, 180 / 3.14159
TURN = 180 / 3.14159 * 60


@dataclass(frozen=True)
class Panel:
    """``shape``: last, alive (1 where a value came), rows, mean, count or a window's aggregate with its length in ``every``.
    ``within`` is the range back from the as-of instant; empty means the dashboard's own range."""

    name: str
    measurement: str
    shape: str = "last"
    within: str = "10 minutes"
    factor: float = 1.0
    field: str = "value"
    every: str = ""
    filled: bool = False
    tag: tuple[str, tuple[str, ...]] | None = None
    by: tuple[str, ...] = ()


def _station(name: str, field: str, **more: object) -> Panel:
    return Panel(name, "weather.station", "rows", "", field=field, by=("station_name",), **more)  # type: ignore[arg-type]


# What each panel reads.
PANELS = [
    _station("wind_by_buoy", "wind_speed_kts", tag=("type", ("ndbc",))), _station("wind_by_station", "wind_speed_kts"), _station("direction_by_station", "wind_dir"), _station("gusts_by_station", "wind_gust_kts"),
    _station("pressure_by_station", "pressure_hpa"), _station("wave_height_by_station", "wave_height_m"), _station("wave_period_by_station", "wave_period_s"), _station("wave_direction_by_station", "wave_dir"),
    Panel("wind_mean_ct", "weather.station", "mean", "15 minutes", field="wind_speed_kts", tag=("zone", ("CT",))), Panel("wind_mean_li", "weather.station", "mean", "15 minutes", field="wind_speed_kts", tag=("zone", ("LI",))),
    Panel("stations_latest", "weather.station", "pivot", "30 minutes", field="wind_speed_kts wind_dir wind_gust_kts", by=("station_name", "zone")), Panel("alert_log", "alerts.log", "rows", ""),
    Panel("helm_counts", "regatta.helmsman", "count", "", field="name", by=("value_string",)), Panel("race_events", "regatta.events", "rows", "", field="note"), Panel("sails_used", "regatta.sails", "rows", "", field="sail"),
    Panel("start_line", "regatta.start_line", "pivot", "", field="lat lon", by=("time",)), Panel("tacks_and_gybes", "regatta.events", "rows", "", tag=("type", ("tack", "gybe"))), Panel("track", "navigation.position", "pivot", "", field="lat lon", by=("time",)),
    Panel("sog", "navigation.speedOverGround", "rows", "", KNOTS), Panel("cog", "navigation.courseOverGroundTrue", "rows", "", DEGREES), Panel("roll", "navigation.attitude.roll", "rows", "", DEGREES), Panel("pitch", "navigation.attitude.pitch", "rows", "", DEGREES),
    Panel("sog_5m", "navigation.speedOverGround", "mean", "", KNOTS, every="5 minutes"), Panel("roll_30s", "navigation.attitude.roll", "mean", "", DEGREES, every="30 seconds"), Panel("pitch_30s", "navigation.attitude.pitch", "mean", "", DEGREES, every="30 seconds"),
    Panel("sog_5s", "navigation.speedOverGround", "mean", "5 minutes", KNOTS, every="5 seconds"), Panel("roll_5s", "navigation.attitude.roll", "mean", "5 minutes", DEGREES_LONG, every="5 seconds"), Panel("pitch_5s", "navigation.attitude.pitch", "mean", "5 minutes", DEGREES_LONG, every="5 seconds"),
    Panel("heading_10s", "navigation.headingTrue", "mean", "1 hour", DEGREES, every="10 seconds", filled=True), Panel("sog_10s", "navigation.speedOverGround", "mean", "1 hour", KNOTS, every="10 seconds", filled=True), Panel("turn_10s", "navigation.rateOfTurn", "mean", "1 hour", TURN, every="10 seconds", filled=True),
    Panel("helm_changes_30m", "regatta.helmsman", "count", "6 hours", every="30 minutes", filled=True, field=""), Panel("sail_changes_30m", "regatta.sails", "count", "6 hours", every="30 minutes", filled=True, field=""),
    Panel("cpu_temperature", "environment.system.cpuTemperature", within=""), Panel("heading_now", "navigation.headingTrue", factor=DEGREES), Panel("sog_now", "navigation.speedOverGround", factor=KNOTS), Panel("cog_now", "navigation.courseOverGround", factor=DEGREES_SHORT),
    Panel("sog_gauge", "navigation.speedOverGround", within="2 minutes", factor=KNOTS), Panel("heading_gauge", "navigation.headingTrue", within="2 minutes", factor=DEGREES_LONG), Panel("roll_gauge", "navigation.attitude.roll", within="2 minutes", factor=DEGREES_LONG), Panel("pitch_gauge", "navigation.attitude.pitch", within="2 minutes", factor=DEGREES_LONG),
    Panel("sog_stat", "navigation.speedOverGround", within="1 minute", factor=KNOTS), Panel("cog_stat", "navigation.courseOverGroundTrue", within="1 minute", factor=DEGREES), Panel("helmsman_now", "regatta.helmsman", field=""), Panel("sails_now", "regatta.sails", field=""), Panel("line_now", "regatta.start_line", field=""),
    *(Panel(f"alive_{m.rsplit('.', 1)[-1]}", m, "alive", "5 minutes", field="") for m in ("navigation.speedOverGround", "navigation.position.latitude", "navigation.headingTrue", "navigation.attitude.roll", "environment.wind.speedApparent", "environment.depth.belowKeel", "environment.water.temperature", "regatta.events")),
    *(Panel(f"sky_{m.rsplit('.', 1)[-1]}", m, within="1 day") for m in ("environment.sun.sunriseTime", "environment.sun.sunsetTime", "environment.moon.illumination", "environment.moon.phase", "environment.moon.moonriseTime", "environment.moon.moonsetTime")),
    *(Panel(f"sails_{f}", "regatta.sails", within="6 hours", field=f) for f in ("mainsail_config", "headsail_config", "downwind_sail", "sail_note")), Panel("start_timer", "regatta.timer", within="1 hour", field="start_timer_seconds"),
    *(Panel(f"line_{f}", "regatta.start_line", within="1 hour", field=f) for f in ("distance_to_line_m", "line_side", "pin_buoy_bearing_deg", "pin_buoy_dist_m", "pin_rc_bearing_deg", "pin_rc_dist_m", "start_line_length_m", "line_bias_deg")),
    *(Panel(f"crew_{f}", "regatta.helmsman", within="6 hours", field=f) for f in ("helm_name", "helm_watch_duration_min", "next_helm_name")), Panel("watch_history", "regatta.helmsman", "rows", "24 hours", field="helm_watch_duration_min"),
]


def panel(points: DataFrame, spec: Panel, asof: Column, dashboard: str = "6 hours") -> DataFrame:
    """One panel's rows, its values in display units."""
    s = Series(points, spec.by or ("measurement", "field"), value="value_double").range(asof, spec.within or dashboard).measurement(spec.measurement)
    fields = spec.field.split()
    if fields:
        s = s.where(F.col("field").isin(fields))
    if spec.tag:
        s = s.where(F.try_element_at("tags", F.lit(spec.tag[0])).isin(*spec.tag[1]))
    known = set(points.columns)
    s = s._with(s.df.withColumns({k: F.try_element_at("tags", F.lit(k)) for k in spec.by if k not in known}))
    if spec.shape == "pivot":
        rows = s.df if "time" in spec.by else s.group(*spec.by, "field").last()
        return Series(rows, value="value_double").pivot(list(spec.by), "field", fields)
    if spec.factor != 1.0:
        s = s.map(F.col("value_double") * spec.factor)
    if spec.shape == "rows":
        return s.df
    if spec.shape in ("last", "alive"):
        last = s.last()
        return last.withColumn("value_double", F.lit(1.0)) if spec.shape == "alive" else last
    if spec.every:
        return s.filled_windows(spec.every, spec.shape) if spec.filled else s.windows(spec.every, spec.shape)
    return s.aggregate(spec.shape)


def latest_panels(points: DataFrame, asof: Column, specs: list[Panel] = PANELS, dashboard: str = "6 hours") -> DataFrame:
    """(panel, value, time) of all panels that show a latest number, from one scan over the widest range."""
    own = [p for p in specs if p.shape in ("last", "alive")]
    seconds = {p.name: _seconds(p.within or dashboard) for p in own}
    table = F.broadcast(points.sparkSession.createDataFrame([(p.name, p.measurement, p.field, p.factor, p.shape == "alive", seconds[p.name]) for p in own], "panel string, m string, f string, factor double, alive boolean, within int"))
    t = F.col("time")
    last = points.filter((t < asof) & (t >= asof - F.make_dt_interval(secs=F.lit(max(seconds.values())))) & F.col("measurement").isin(*{p.measurement for p in own})).groupBy("measurement", "field").agg(F.max_by("value_double", "time").alias("v"), F.max("time").alias("time"))
    joined = last.join(table, (F.col("measurement") == F.col("m")) & ((F.col("f") == "") | (F.col("field") == F.col("f")))).filter(F.col("time") >= asof - F.make_dt_interval(secs=F.col("within")))
    return joined.select("panel", "field", F.when(F.col("alive"), F.lit(1.0)).otherwise(F.col("v") * F.col("factor")).alias("value"), "time")


def windowed_panels(points: DataFrame, asof: Column, specs: list[Panel], dashboard: str = "6 hours") -> DataFrame:
    """(panel, time, value) of all panels of windowed figures, from one scan and one shuffle: each point meets the
    panels of its measurement, and is grouped by panel and window. Without rows a window gives no row."""
    own = [p for p in specs if p.every]
    table = [(p.name, p.measurement, p.field.split() or None, p.factor, p.shape, _seconds(p.within or dashboard), _seconds(p.every) * 1_000_000) for p in own]
    rules = F.broadcast(points.sparkSession.createDataFrame(table, "panel string, measurement string, __fields array<string>, __factor double, __shape string, __within int, __every long"))
    t, widest = F.col("time"), max(row[5] for row in table)
    rows = points.filter((t < asof) & (t >= asof - F.make_dt_interval(secs=F.lit(widest))) & F.col("measurement").isin(*{p.measurement for p in own})).join(rules, "measurement")
    rows = rows.filter((t >= asof - F.make_dt_interval(secs=F.col("__within"))) & (F.col("__fields").isNull() | F.array_contains("__fields", F.col("field"))))
    us = F.unix_micros(t)
    closes = F.timestamp_micros(us - F.pmod(us, F.col("__every")) + F.col("__every"))
    value = F.col("value_double") * F.col("__factor")
    figures = {"mean": F.avg(value), "min": F.min(value), "max": F.max(value), "sum": F.sum(value), "count": F.count("value_double").cast("double"), "last": F.max_by(value, t)}
    shapes = sorted({p.shape for p in own})
    grouped = rows.groupBy("panel", "__shape", "field", closes.alias("time")).agg(*(figures[s].alias(f"__{s}") for s in shapes))
    return grouped.select("panel", "field", "time", F.coalesce(*(F.when(F.col("__shape") == s, F.col(f"__{s}")) for s in shapes)).alias("value"))


#: What a panel shows of its rows in one number (the dashboards' reducers).
REDUCERS = {"lastNotNull": lambda v, t: F.max_by(v, F.when(v.isNotNull(), t)), "firstNotNull": lambda v, t: F.min_by(v, F.when(v.isNotNull(), t)), "mean": lambda v, t: F.avg(v), "min": lambda v, t: F.min(v), "max": lambda v, t: F.max(v), "sum": lambda v, t: F.sum(v), "count": lambda v, t: F.count(v).cast("double"), "range": lambda v, t: F.max(v) - F.min(v)}


def reduced(points: DataFrame, asof: Column, wanted: dict[str, tuple[str, str]], within: str = "6 hours") -> DataFrame:
    """(panel, value): ``wanted`` maps panels to a measurement and a reducer's name; one scan, one aggregate, a row for each panel with points."""
    table = F.broadcast(points.sparkSession.createDataFrame([(k, m, r) for k, (m, r) in wanted.items()], "panel string, measurement string, __how string"))
    t = F.col("time")
    rows = points.filter((t < asof) & (t >= asof - F.expr(f"interval {within}")) & F.col("measurement").isin(*{m for m, _ in wanted.values()})).join(table, "measurement")
    names = sorted({r for _, r in wanted.values()})
    found = rows.groupBy("panel", "__how").agg(*(REDUCERS[r](F.col("value_double"), t).alias(f"__{r}") for r in names))
    return found.select("panel", F.coalesce(*(F.when(F.col("__how") == r, F.col(f"__{r}")) for r in names)).alias("value"))


def _seconds(interval: str) -> int:
    n, unit = interval.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def coloured(value: Column, steps: list[tuple[float | None, str]]) -> Column:
    """The colour of the highest step that the value reaches; the first step has no bound."""
    out = F.lit(steps[0][1])
    for bound, colour in steps[1:]:
        out = F.when(value >= bound, colour).otherwise(out)
    return out


def mapped(value: Column, names: dict[str, str]) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[value], value)


def panel_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p.name, p.measurement, p.field, p.shape, p.within, p.factor, p.every) for p in PANELS], "panel string, measurement string, field string, shape string, within string, factor double, every string")
