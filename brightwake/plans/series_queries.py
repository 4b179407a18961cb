"""Registered queries over point series, each with DuckDB SQL of the same result.

Points come from the events table (``sources.points``): event_type is the measurement, user_id the tag. All
times are relative to the latest event.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brightwake.functions import angles, classify, geo, nautical, units
from brightwake.operators import joins, rolling
from brightwake.operators.series import Series, latest, stale
from brightwake.sources import points as P

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def asof(df: DataFrame, time: str = "time") -> Column:
    """The latest time, as a literal, so that ranges reach the scan as constants."""
    return F.lit(df.agg(F.max(time)).first()[0])


def stamp(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def r8(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 8)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(time, kind, user, value, event_id)."""
    return P.events(spark, sf_dir).select(F.col("ts").alias("time"), F.col("event_type").alias("kind"), F.col("user_id").alias("user"), "value", "event_id", "props")


def per_user(spark: SparkSession, sf_dir: str) -> Series:
    return Series(events(spark, sf_dir), ("kind", "user"))


ASOF = "(SELECT max(ts) FROM events)"
STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


@query(f"SELECT event_type AS kind, user_id AS \"user\", round(arg_max(value, ts) * 1.94384, 8) AS knots, {STAMP.format('max(ts)')} AS seen FROM events WHERE event_type = 'click' AND ts < {ASOF} AND ts >= {ASOF} - INTERVAL 10 DAY GROUP BY ALL")
def last_per_series(spark, sf_dir):
    s = per_user(spark, sf_dir)
    last = s.range(asof(s.df), "10 days").where(F.col("kind") == "click").last()
    return last.select("kind", "user", r8(units.knots(F.col("value"))).alias("knots"), stamp("time").alias("seen"))


@query(f"SELECT event_type AS kind, user_id AS \"user\", arg_min(value, ts) AS value, {STAMP.format('min(ts)')} AS seen FROM events GROUP BY ALL")
def first_per_series(spark, sf_dir):
    return per_user(spark, sf_dir).first().select("kind", "user", "value", stamp("time").alias("seen"))


@query(f"SELECT event_type AS kind, user_id AS \"user\", round(avg(value), 8) AS mean FROM events WHERE ts >= {ASOF} - INTERVAL 5 DAY AND ts < {ASOF} GROUP BY ALL")
def range_mean(spark, sf_dir):
    s = per_user(spark, sf_dir)
    return s.range(asof(s.df), "5 days").aggregate("mean").select("kind", "user", r8("value").alias("mean"))


@query(f"SELECT event_type AS kind, count(*) AS n FROM events WHERE ts >= {ASOF} - INTERVAL 20 DAY AND ts < {ASOF} - INTERVAL 10 DAY GROUP BY ALL")
def count_bounded_range(spark, sf_dir):
    s = per_user(spark, sf_dir)
    return s.range(asof(s.df), "20 days", "10 days").group("kind").aggregate("count").withColumnRenamed("value", "n")


@query("SELECT event_type AS kind, user_id AS \"user\", count(*) AS n FROM events GROUP BY ALL")
def count_per_series(spark, sf_dir):
    return per_user(spark, sf_dir).aggregate("count").withColumnRenamed("value", "n")


@query("SELECT CAST(floor(value / 50) AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY ALL")
def count_by_value(spark, sf_dir):
    return events(spark, sf_dir).groupBy(F.floor(F.col("value") / 50).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT event_type AS kind FROM events")
def distinct_measurements(spark, sf_dir):
    return events(spark, sf_dir).select("kind").distinct()


@query("SELECT user_id AS \"user\", arg_max(value, ts) FILTER (event_type = 'click') AS click, arg_max(value, ts) FILTER (event_type = 'view') AS \"view\", arg_max(value, ts) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY ALL HAVING count(*) FILTER (event_type IN ('click', 'view', 'purchase')) > 0")
def pivot_latest(spark, sf_dir):
    last = per_user(spark, sf_dir).where(F.col("kind").isin("click", "view", "purchase")).last()
    return Series(last).pivot(["user"], "kind", ["click", "view", "purchase"])


@query("SELECT user_id AS \"user\", round(arg_max(value / 50, ts) FILTER (event_type = 'click'), 8) AS sog, round(arg_max(value / 55, ts) FILTER (event_type = 'view'), 8) AS stw, round(arg_max(value, ts) FILTER (event_type = 'error'), 8) AS depth FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY ALL")
def conditional_latest_struct(spark, sf_dir):
    rows = latest(events(spark, sf_dir), {"sog": "click", "stw": "view", "depth": "error"}, by=["user"], name="kind")
    return rows.select("user", r8(F.col("sog") / 50).alias("sog"), r8(F.col("stw") / 55).alias("stw"), r8("depth").alias("depth"))


@query(f"SELECT event_type AS kind, {STAMP.format('time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE')} AS closed, round(avg(value), 8) AS mean FROM events GROUP BY ALL")
def tumbling_mean_5m(spark, sf_dir):
    return per_user(spark, sf_dir).group("kind").windows("5 minutes").select("kind", stamp("time").alias("closed"), r8("value").alias("mean"))


_GRID = "WITH w AS (SELECT event_type AS kind, time_bucket(INTERVAL {0}, ts) + INTERVAL {0} AS t, {1} AS v FROM events GROUP BY ALL), g AS (SELECT kind, unnest(generate_series(min(t), max(t), INTERVAL {0})) AS t FROM w GROUP BY kind) SELECT g.kind, strftime(g.t, '%Y-%m-%d %H:%M:%S.%f') AS closed, {2} AS {3} FROM g LEFT JOIN w ON g.kind = w.kind AND g.t = w.t"


@query(_GRID.format("1 HOUR", "avg(value)", "round(w.v, 8)", "mean"))
def tumbling_mean_gapfill(spark, sf_dir):
    return per_user(spark, sf_dir).group("kind").filled_windows("1 hour").select("kind", stamp("time").alias("closed"), r8("value").alias("mean"))


@query(_GRID.format("30 MINUTE", "count(*)", "coalesce(w.v, 0)", "n"))
def tumbling_count_30m_gapfill(spark, sf_dir):
    return per_user(spark, sf_dir).group("kind").filled_windows("30 minutes", "count").select("kind", stamp("time").alias("closed"), F.col("value").alias("n"))


@query(f"SELECT event_type AS kind, {STAMP.format('time_bucket(INTERVAL 1 DAY, ts)')} AS day, round(avg(value), 8) AS mean, min(value) AS low, max(value) AS high, count(*) AS n FROM events GROUP BY ALL")
def retention_rollup_daily(spark, sf_dir):
    w = F.window("time", "1 day")
    return events(spark, sf_dir).groupBy("kind", w.alias("w")).agg(r8(F.avg("value")).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("n")).select("kind", stamp("w.start").alias("day"), "mean", "low", "high", "n")


@query("SELECT event_type AS kind, user_id AS \"user\", event_id, CAST(row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id) AS INTEGER) AS \"order\" FROM events QUALIFY \"order\" <= 3")
def topn_per_series(spark, sf_dir):
    return per_user(spark, sf_dir).limit(3, F.desc("time"), F.col("event_id")).select("kind", "user", "event_id", "order")


@query(f"WITH a AS (SELECT event_type AS kind, arg_max(value, ts) FILTER (ts >= {ASOF} - INTERVAL 12 HOUR) AS now, arg_max(value, ts) FILTER (ts < {ASOF} - INTERVAL 12 HOUR) AS before FROM events WHERE ts < {ASOF} AND ts >= {ASOF} - INTERVAL 24 HOUR GROUP BY ALL) SELECT kind, now, before, round(now - before, 8) AS change, CASE WHEN now - before > 0.5 THEN 'Warming' WHEN now - before < -0.5 THEN 'Cooling' WHEN now - before IS NOT NULL THEN 'Stable' END AS trend FROM a")
def two_range_trend(spark, sf_dir):
    rows = events(spark, sf_dir)
    out = rolling.two_ranges(rows, ["kind"], "value", asof(rows), "12 hours", "24 hours")
    return out.select("kind", "now", "before", r8("change").alias("change"), classify.trend(F.col("change"), 0.5, "Warming", "Cooling").alias("trend"))


_ROLL = "SELECT event_id, round({}(value) OVER (PARTITION BY event_type, user_id ORDER BY ts RANGE BETWEEN INTERVAL {} PRECEDING AND CURRENT ROW), 8) AS {} FROM events"


@query(_ROLL.format("avg", "6 HOUR", "mean"))
def rolling_mean(spark, sf_dir):
    return rolling.moving(events(spark, sf_dir), ["kind", "user"], "value", "6 hours", "mean").select("event_id", r8("mean").alias("mean"))


@query(_ROLL.format("stddev_samp", "2 DAY", "spread"))
def rolling_stddev(spark, sf_dir):
    return rolling.moving(events(spark, sf_dir), ["kind", "user"], "value", "2 days", "spread", "stddev").select("event_id", r8("spread").alias("spread"))


@query("SELECT event_id, round(value - first_value(value) OVER (PARTITION BY event_type, user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW), 8) AS change FROM events")
def change_over_window(spark, sf_dir):
    return rolling.change(events(spark, sf_dir), ["kind", "user"], "value", "1 day", "change").select("event_id", r8("change").alias("change"))


@query("WITH d AS (SELECT *, (event_id * 37) % 360 AS deg FROM events) SELECT event_id, CAST(((deg - first_value(deg) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)) + 540 + 360) % 360 - 180 AS DOUBLE) AS shift FROM d")
def shift_over_window(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("deg", (F.col("event_id") * 37 % 360).cast("double"))
    return rolling.change(rows, ["user"], "deg", "1 day", "shift", angle=True).select("event_id", r8("shift").alias("shift"))


@query("WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type = 'click'), a AS (SELECT user_id AS \"user\", max(n) AS n, avg(value) FILTER (i > floor(n / 2)) - avg(value) FILTER (i <= floor(n / 2)) AS d FROM p GROUP BY user_id) SELECT \"user\", n, round(d, 8) AS change, CASE WHEN n < 4 THEN NULL WHEN d > 0.2 THEN 'up' WHEN d < -0.2 THEN 'down' ELSE 'flat' END AS trend FROM a")
def half_split_trend(spark, sf_dir):
    rows = events(spark, sf_dir).filter("kind = 'click'")
    return rolling.half_trend(rows, ["user"], "value").select("user", "n", r8("change").alias("change"), "trend")


_TICKS = "t AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), q AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view')"


@query(f"WITH {_TICKS} SELECT t.event_id, q.value AS seen FROM t ASOF LEFT JOIN q ON t.user_id = q.user_id AND t.ts >= q.ts")
def asof_latest(spark, sf_dir):
    rows = events(spark, sf_dir)
    ticks, readings = rows.filter("kind = 'click'").select("event_id", "user", "time"), rows.filter("kind = 'view'").select("user", "time", "value")
    return joins.asof(ticks, readings, ["user"]).select("event_id", F.col("value").alias("seen"))


@query(f"WITH {_TICKS} SELECT t.event_id, q.value AS seen FROM t ASOF LEFT JOIN q ON t.user_id = q.user_id AND t.ts >= q.ts")
def asof_latest_bucketed(spark, sf_dir):
    rows = events(spark, sf_dir)
    ticks, readings = rows.filter("kind = 'click'").select("event_id", "user", "time"), rows.filter("kind = 'view'").select("user", "time", "value")
    return joins.asof_bucketed(ticks, readings, ["user"], "day").select("event_id", F.col("value").alias("seen"))


_POLAR = "polar AS (SELECT * FROM (VALUES " + ", ".join(str(p) for p in P.POLAR) + ") AS v(tws, upwind, reach, downwind, upwind_angle, downwind_angle)), steps AS (SELECT *, lead(tws) OVER (ORDER BY tws) AS hi, lead(upwind) OVER (ORDER BY tws) AS u1, lead(reach) OVER (ORDER BY tws) AS r1, lead(downwind) OVER (ORDER BY tws) AS d1, row_number() OVER (ORDER BY tws) AS i FROM polar)"
_BOAT = "b AS (SELECT event_id, 3.0 + event_id % 25 + value / 1000 AS tws, abs((event_id * 53) % 361 - 180) AS twa, value / 55 AS stw FROM events)"
_AT = "onp AS (SELECT b.*, CASE WHEN hi IS NULL THEN 0 ELSE greatest(0, (b.tws - steps.tws) / (hi - steps.tws)) END AS f, upwind, reach, downwind, coalesce(u1, upwind) AS u1, coalesce(r1, reach) AS r1, coalesce(d1, downwind) AS d1 FROM b JOIN steps ON (b.tws >= steps.tws OR i = 1) AND (b.tws < hi OR hi IS NULL)), s AS (SELECT *, CASE WHEN twa < 60 THEN 'upwind' WHEN twa <= 150 THEN 'reach' ELSE 'downwind' END AS mode FROM onp), z AS (SELECT *, CASE mode WHEN 'upwind' THEN upwind + f * (u1 - upwind) WHEN 'reach' THEN reach + f * (r1 - reach) ELSE downwind + f * (d1 - downwind) END AS target FROM s)"


def _on_polar(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", (F.lit(3.0) + F.col("event_id") % 25 + F.col("value") / 1000).alias("tws"), F.abs(F.col("event_id") * 53 % 361 - 180).alias("twa"), (F.col("value") / 55).alias("stw"))
    rows = joins.interpolated(rows.withColumnRenamed("tws", "wind"), "wind", P.polar(spark), "tws", ["upwind", "reach", "downwind"]).withColumn("mode", classify.mode_from_true(F.col("twa")))
    return rows.withColumn("target", F.when(F.col("mode") == "upwind", F.col("upwind")).when(F.col("mode") == "reach", F.col("reach")).otherwise(F.col("downwind")))


@query(f"WITH {_POLAR}, {_BOAT}, {_AT} SELECT event_id, mode, round(target, 8) AS target_knots FROM z")
def polar_target_speed(spark, sf_dir):
    return _on_polar(spark, sf_dir).select("event_id", "mode", r8("target").alias("target_knots"))


@query(f"WITH {_POLAR}, {_BOAT}, {_AT}, e AS (SELECT *, 100 * (stw * 1.944) / target AS eff FROM z) SELECT mode, CASE WHEN eff > 95 THEN 'Excellent' WHEN eff > 90 THEN 'Good' WHEN eff > 80 THEN 'Fair' ELSE 'Poor' END AS grade, count(*) AS n, round(avg(eff), 8) AS mean FROM e GROUP BY ALL")
def polar_efficiency_class(spark, sf_dir):
    rows = _on_polar(spark, sf_dir).withColumn("eff", 100 * units.knots_short(F.col("stw")) / F.col("target"))
    return rows.groupBy("mode", classify.efficiency_grade(F.col("eff")).alias("grade")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("eff"), 8).alias("mean"))


_KIN = "k AS (SELECT event_id, user_id, event_type, ts, value / 50 AS sog, radians((event_id * 37) % 360) AS cog, value / 55 AS stw, radians((event_id * 37 + user_id) % 360) AS hdg, 41 + (user_id % 100) / 100.0 AS lat, -73 + (event_id % 200) / 100.0 AS lon FROM events)"


def _motion(spark, sf_dir):
    i, u, v = F.col("event_id"), F.col("user"), F.col("value")
    return events(spark, sf_dir).withColumns({"sog": v / 50, "cog": F.radians(i * 37 % 360), "stw": v / 55, "hdg": F.radians((i * 37 + u) % 360), "lat": 41 + (u % 100) / 100.0, "lon": -73 + (i % 200) / 100.0})


@query(f"WITH {_KIN}, c AS (SELECT event_id, sog * sin(cog) - stw * sin(hdg) AS e, sog * cos(cog) - stw * cos(hdg) AS n FROM k) SELECT event_id, round(sqrt(e * e + n * n), 8) AS drift, round(((degrees(atan2(e, n)) % 360) + 360) % 360, 6) AS set_degrees FROM c")
def current_vector(spark, sf_dir):
    args = [F.col(c) for c in ("sog", "cog", "stw", "hdg")]
    return _motion(spark, sf_dir).select("event_id", r8(nautical.current_drift(*args)).alias("drift"), F.round(F.degrees(nautical.current_set(*args)), 6).alias("set_degrees"))


@query("SELECT event_type AS kind, round(((degrees(atan2(avg(sin(radians((event_id * 37) % 360))), avg(cos(radians((event_id * 37) % 360))))) % 360) + 360) % 360, 6) AS mean_direction FROM events WHERE value < 100 GROUP BY ALL")
def circular_mean_by_type(spark, sf_dir):
    rows = events(spark, sf_dir).filter("value < 100").withColumn("deg", F.col("event_id") * 37 % 360)
    return rows.groupBy("kind").agg(F.round(angles.circular_mean(F.col("deg")), 6).alias("mean_direction"))


@query("SELECT event_id, ((event_id * 37) % 360 - (event_id * 53) % 360 + 540) % 360 - 180 AS apart, least(abs((event_id * 37) % 360 - (event_id * 53) % 360), 360 - abs((event_id * 37) % 360 - (event_id * 53) % 360)) AS folded FROM events")
def signed_angle_diff(spark, sf_dir):
    a, b = F.col("event_id") * 37 % 360, F.col("event_id") * 53 % 360
    return events(spark, sf_dir).select("event_id", angles.difference(a, b).cast("long").alias("apart"), angles.fold_180(a - b).alias("folded"))


_HAV = "2 * {0} * atan2(sqrt(a), sqrt(1 - a))"
_MARK = f"WITH {_KIN}, h AS (SELECT event_id, lat, lon, sin(radians(41.063 - lat) / 2) * sin(radians(41.063 - lat) / 2) + cos(radians(lat)) * cos(radians(41.063)) * sin(radians(-73.591 - lon) / 2) * sin(radians(-73.591 - lon) / 2) AS a FROM k)"


@query(f"{_MARK} SELECT event_id, round({_HAV.format(6371.0)}, 8) AS km, round({_HAV.format(3440.065)}, 8) AS nm FROM h")
def haversine_matrix(spark, sf_dir):
    here = (F.col("lat"), F.col("lon"), F.lit(41.063), F.lit(-73.591))
    return _motion(spark, sf_dir).select("event_id", r8(geo.distance(*here, geo.EARTH_KM)).alias("km"), r8(geo.distance(*here, geo.EARTH_NM)).alias("nm"))


@query(f"WITH {_KIN} SELECT event_id, round(((degrees(atan2(sin(radians(-73.591 - lon)) * cos(radians(41.063)), cos(radians(lat)) * sin(radians(41.063)) - sin(radians(lat)) * cos(radians(41.063)) * cos(radians(-73.591 - lon)))) + 360) % 360), 6) AS bearing FROM k")
def bearing_matrix(spark, sf_dir):
    return _motion(spark, sf_dir).select("event_id", F.round(geo.bearing(F.col("lat"), F.col("lon"), F.lit(41.063), F.lit(-73.591)), 6).alias("bearing"))


_LINE = f"WITH {_KIN}, m AS (SELECT event_id, (lon + 73.0) * (111319.9 * cos(radians(41.25))) AS px, (lat - 41.0) * 111319.9 AS py, 2.0 * (111319.9 * cos(radians(41.25))) AS bx, 0.5 * 111319.9 AS byy FROM k), d AS (SELECT event_id, (bx * py - byy * px) / sqrt(bx * bx + byy * byy) AS m FROM m)"


@query(f"{_LINE} SELECT event_id, round(m, 6) AS metres, CASE WHEN abs(m) < 50 THEN 'on line' WHEN m > 0 THEN 'before' ELSE 'behind' END AS side FROM d")
def start_line_side(spark, sf_dir):
    m = geo.line_side(F.lit(41.0), F.lit(-73.0), F.lit(41.5), F.lit(-71.0), F.col("lat"), F.col("lon"))
    return _motion(spark, sf_dir).select("event_id", F.round(m, 6).alias("metres"), classify.start_line_side(m).alias("side"))


@query("WITH d AS (SELECT event_id, (event_id * 37) % 720 - 180 AS deg FROM events) SELECT event_id, list_extract(['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'], CAST((CAST(floor(deg / 22.5 + 0.5) AS BIGINT) % 16 + 16) % 16 AS BIGINT) + 1) AS point FROM d")
def compass16(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", angles.compass(F.col("event_id") * 37 % 720 - 180).alias("point"))


_VMG = f"WITH {_KIN} SELECT event_id, round(sog * cos(radians(least(abs(degrees(cog) - 45), 360 - abs(degrees(cog) - 45)))), 8) AS vmg, round((lat - 41) * 60 / greatest(sog, 0.1), 8) AS hours FROM k"


@query(_VMG)
def vmg_and_time_to_mark(spark, sf_dir):
    return _motion(spark, sf_dir).select("event_id", r8(nautical.vmg_to_mark(F.col("sog"), F.degrees("cog"), F.lit(45))).alias("vmg"), r8(nautical.time_to_mark((F.col("lat") - 41) * 60, F.col("sog"))).alias("hours"))


@query("WITH n AS (SELECT c_custkey, lower(c_name) AS name, c_mktsegment FROM customer), r AS (SELECT * FROM (VALUES (1, 'customer#000000001', CAST(150 AS DOUBLE)), (2, '00001', CAST(171 AS DOUBLE)), (3, '#00000000', CAST(180 AS DOUBLE))) AS v(i, k, phrf)) SELECT c_custkey, (SELECT phrf FROM r WHERE contains(n.name, r.k) OR contains(r.k, n.name) ORDER BY i LIMIT 1) AS rating FROM n")
def fuzzy_rating_join(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    found = joins.first_contained(rows, F.col("c_name"), {"Customer#000000001": 150, "00001": 171, "#00000000": 180})
    return found.select("c_custkey", "rating")


@query("WITH l AS (SELECT user_id, arg_max(value, ts) AS v FROM events WHERE event_type = 'view' GROUP BY ALL) SELECT arg_max(user_id, struct_pack(v := v, o := -user_id)) AS strongest, arg_min(user_id, struct_pack(v := v, o := user_id)) AS weakest, round(avg(v), 1) AS mean FROM l")
def strongest_weakest(spark, sf_dir):
    last = per_user(spark, sf_dir).where(F.col("kind") == "view").last()
    return last.agg(F.max_by("user", F.struct("value", -F.col("user"))).alias("strongest"), F.min_by("user", F.struct("value", "user")).alias("weakest"), F.round(F.avg("value"), 1).alias("mean"))


@query("WITH z AS (SELECT avg(value) FILTER (user_id % 5 = 0) AS east, avg(value) FILTER (user_id % 5 = 1) AS west FROM events) SELECT round(east, 8) AS east, round(west, 8) AS west, round(east - west, 8) AS difference, CASE WHEN east - west > 0.5 THEN 'east' WHEN east - west < -0.5 THEN 'west' ELSE 'even' END AS stronger FROM z")
def zone_difference(spark, sf_dir):
    zone = F.col("user") % 5
    z = events(spark, sf_dir).agg(F.avg(F.when(zone == 0, F.col("value"))).alias("east"), F.avg(F.when(zone == 1, F.col("value"))).alias("west"))
    d = F.col("east") - F.col("west")
    return z.select(r8("east").alias("east"), r8("west").alias("west"), r8(d).alias("difference"), classify.trend(d, 0.5, "east", "west", "even").alias("stronger"))


@query(f"WITH h AS (SELECT event_type, user_id, ts, epoch_us(lead(ts, 1, {ASOF}) OVER (PARTITION BY event_type ORDER BY ts)) - epoch_us(ts) AS us FROM events) SELECT event_type AS kind, user_id AS helm, round(sum(us) / 1000000.0, 6) AS seconds, count(*) AS turns FROM h GROUP BY ALL")
def watch_durations(spark, sf_dir):
    rows = events(spark, sf_dir)
    return rolling.durations(rows, ["kind"], "user", asof(rows)).select("kind", F.col("user").alias("helm"), F.round("seconds", 6).alias("seconds"), "turns")


@query("WITH b AS (SELECT event_id, user_id, value, max(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events) SELECT event_id, value, best AS previous_best FROM b WHERE value > best + 0.5")
def speed_record(spark, sf_dir):
    return rolling.records(events(spark, sf_dir), ["user"], "value", 0.5).select("event_id", "value", "previous_best")


@query("WITH s AS (SELECT event_id, user_id, ts, sign(value - 245) AS s FROM events), l AS (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM s) SELECT event_id FROM l WHERE b <> s AND s <> 0")
def line_crossings(spark, sf_dir):
    return rolling.crossings(events(spark, sf_dir).withColumn("value", F.col("value") - 245), ["user"], "value").select("event_id")


@query(f"WITH l AS (SELECT event_type AS kind, user_id AS \"user\", arg_max(value, ts) AS v FROM events WHERE ts < {ASOF} AND ts >= {ASOF} - INTERVAL 5 DAY GROUP BY ALL) SELECT kind, \"user\", v AS value FROM l WHERE v > 400")
def alert_threshold_latest(spark, sf_dir):
    """Fires on the latest value."""
    s = per_user(spark, sf_dir)
    return s.range(asof(s.df), "5 days").last().filter("value > 400").select("kind", "user", "value")


@query(f"SELECT event_type AS kind, user_id AS \"user\", arg_max(value, ts) AS value FROM events WHERE ts < {ASOF} AND ts >= {ASOF} - INTERVAL 5 DAY AND value > 400 GROUP BY ALL")
def alert_threshold_any(spark, sf_dir):
    """Fires on the latest value over the threshold: as long as one is in the range."""
    s = per_user(spark, sf_dir)
    return s.range(asof(s.df), "5 days").where(F.col("value") > 400).last().select("kind", "user", "value")


@query(f"WITH d AS (SELECT * FROM (VALUES ('click', 600), ('error', 60), ('signup', 86400), ('sonar', 30)) AS v(measurement, seconds)), s AS (SELECT event_type, max(ts) AS t FROM events GROUP BY ALL) SELECT measurement, seconds, t IS NULL OR t < {ASOF} - to_seconds(seconds) AS stale FROM d LEFT JOIN s ON measurement = event_type")
def staleness(spark, sf_dir):
    rows = events(spark, sf_dir).withColumnRenamed("kind", "measurement")
    sensors = spark.createDataFrame([("click", 600), ("error", 60), ("signup", 86400), ("sonar", 30)], "measurement string, seconds int")
    return stale(rows, sensors, asof(rows)).select("measurement", "seconds", "stale")


@query("SELECT event_id FROM events WHERE regexp_matches(event_type, '^(cl|pur).*') AND value >= 10 AND user_id BETWEEN 20 AND 80")
def regex_filter(spark, sf_dir):
    return per_user(spark, sf_dir).where(F.col("kind").rlike("^(cl|pur).*"), F.col("value") >= 10, F.col("user").between(20, 80)).df.select("event_id")


@query("SELECT event_id FROM events WHERE event_type LIKE 'pu%'")
def prefix_filter(spark, sf_dir):
    return per_user(spark, sf_dir).where(F.col("kind").startswith("pu")).df.select("event_id")


@query("SELECT e.event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events s WHERE s.event_type = 'error' AND s.user_id = e.user_id AND s.value > 450)")
def anti_join_unsent(spark, sf_dir):
    rows = events(spark, sf_dir)
    return joins.unsent(rows, rows.filter("kind = 'error' and value > 450").select("user").distinct(), "user").select("event_id")


@query("SELECT event_id, 'roll' AS series, round(value / 57.2958, 9) AS value FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, 'pitch', round(value / 100, 9) FROM events WHERE event_type = 'view'")
def union_series(spark, sf_dir):
    rows = events(spark, sf_dir)
    one = rows.filter("kind = 'click'").select("event_id", F.lit("roll").alias("series"), F.round(F.col("value") / 57.2958, 9).alias("value"))
    return one.unionByName(rows.filter("kind = 'view'").select("event_id", F.lit("pitch").alias("series"), F.round(F.col("value") / 100, 9).alias("value")))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_path_extract(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@query("WITH v AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 99 WHEN event_id % 11 = 1 THEN 999 WHEN event_id % 11 = 2 THEN 9999 ELSE value END AS v FROM events) SELECT event_id, CASE WHEN v IN (99, 999, 9999) THEN NULL ELSE v END AS value FROM v")
def sentinel_to_null(spark, sf_dir):
    from brightwake.sources.feeds import without_sentinels

    m = F.col("event_id") % 11
    raw = F.when(m == 0, F.lit("99")).when(m == 1, F.lit("999.0")).when(m == 2, F.lit("9999")).otherwise(F.col("value").cast("string"))
    return events(spark, sf_dir).select("event_id", without_sentinels(raw).alias("value"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS b FROM events), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id AS \"user\", strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS began, count(*) AS n FROM s GROUP BY user_id, k")
def session_activity(spark, sf_dir):
    w = F.session_window("time", "30 minutes")
    return events(spark, sf_dir).groupBy("user", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user", stamp("w.start").alias("began"), "n")


@query("SELECT event_id, round(value * 1.94384, 8) AS knots, round(value / 0.51444, 8) AS knots_divided, round(value * 1.944, 8) AS knots_short, round(value / 1.852, 8) AS knots_kmh, round(value - 273.15, 8) AS celsius, round((value - 273.15) * 9 / 5 + 32, 8) AS fahrenheit, round(value * 3.28084, 8) AS feet, round(value / 1852, 9) AS nm, round(value / 100, 8) AS hpa, round(value * 180 / 3.14159 * 60, 6) AS turn FROM events")
def unit_conversions(spark, sf_dir):
    v = F.col("value")
    return events(spark, sf_dir).select(
        "event_id", r8(units.knots(v)).alias("knots"), r8(units.knots_by_division(v)).alias("knots_divided"), r8(units.knots_short(v)).alias("knots_short"), r8(units.knots_from_kmh(v)).alias("knots_kmh"), r8(units.celsius(v)).alias("celsius"),
        r8(units.fahrenheit(units.celsius(v))).alias("fahrenheit"), r8(units.feet(v)).alias("feet"), F.round(units.nautical_miles(v), 9).alias("nm"), r8(units.hectopascal(v)).alias("hpa"), F.round(units.degrees_per_minute(v), 6).alias("turn"),
    )


@query("SELECT event_id, CASE WHEN s % 60 <= 30 THEN greatest(s - s % 60, 0) ELSE s + 60 - s % 60 END AS synced FROM (SELECT event_id, event_id % 4000 AS s FROM events)")
def synced_countdown(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", nautical.synced_timer(F.col("event_id") % 4000).alias("synced"))


@query("WITH o AS (SELECT sum(value) FILTER (user_id = 1) / count(*) FILTER (user_id = 1) AS own FROM events), f AS (SELECT user_id AS boat, avg(value) AS vmg, 120 + user_id % 60 AS phrf FROM events GROUP BY ALL) SELECT boat, round(vmg - own, 8) AS delta, round(vmg * (156.0 / phrf), 8) AS corrected, CASE WHEN vmg - own > 0.1 THEN 'faster' WHEN vmg - own < -0.1 THEN 'slower' ELSE 'equal' END AS class FROM f, o")
def fleet_delta(spark, sf_dir):
    """Each boat against the own one: the one-row side is an aggregate without groups."""
    rows = events(spark, sf_dir)
    own = rows.filter("user = 1").agg(F.avg("value").alias("own")).withColumn("k", F.lit(1))
    fleet = rows.groupBy(F.col("user").alias("boat")).agg(F.avg("value").alias("vmg")).withColumn("k", F.lit(1)).join(F.broadcast(own), "k")
    d = F.col("vmg") - F.col("own")
    return fleet.select("boat", r8(d).alias("delta"), r8(nautical.rated_vmg(F.col("vmg"), 120 + F.col("boat") % 60)).alias("corrected"), classify.fleet_delta(d).alias("class"))


@query("WITH s AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS t, user_id % 3 AS source, avg(value) AS v FROM events GROUP BY ALL) SELECT strftime(t, '%Y-%m-%d %H:%M:%S.%f') AS hour, round(arg_min(v, source), 8) AS best, count(*) AS sources FROM s GROUP BY t")
def source_priority(spark, sf_dir):
    """Several sensors of one quantity: each hour's mean of the source that comes first in the order of preference."""
    each = events(spark, sf_dir).groupBy(F.window("time", "1 hour").alias("w"), (F.col("user") % 3).alias("source")).agg(F.avg("value").alias("v"))
    return each.groupBy("w").agg(F.min_by("v", "source").alias("best"), F.count(F.lit(1)).alias("sources")).select(stamp("w.start").alias("hour"), r8("best").alias("best"), "sources")
