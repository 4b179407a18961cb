"""Further registered queries with their SQL: series cut into buckets, alert states, conjunctions, spreads, ratios, filled ranges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightwake.operators import split
from brightwake.operators.series import Series
from brightwake.plans import alerts, panels
from brightwake.sources import battery, sinks
from brightwake.plans.series_queries import ASOF, STAMP, asof, events, r8, stamp

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


def one_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one series: points of one measurement without further keys."""
    return events(spark, sf_dir)


@query("SELECT event_id, round(avg(value) OVER w, 8) AS mean, count(*) OVER w AS n FROM events WINDOW w AS (ORDER BY ts RANGE BETWEEN INTERVAL '29 minutes 59.999999 seconds' PRECEDING AND CURRENT ROW)")
def moving_mean_strict(spark, sf_dir):
    """One series over all events: half an hour, without what lies exactly half an hour back."""
    found = split.moving(one_series(spark, sf_dir), [], {"mean": ("mean", "value"), "n": ("count", F.lit(1))}, "30 minutes")
    return found.select("event_id", r8("mean").alias("mean"), "n")


@query("WITH b AS (SELECT event_id, value, max(value) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events) SELECT event_id, value, best AS previous_best FROM b WHERE value > best + 0.5")
def fleet_record(spark, sf_dir):
    return split.records(one_series(spark, sf_dir), [], "value", 0.5, order=("event_id",)).select("event_id", "value", "previous_best")


@query(f"WITH h AS (SELECT event_type, epoch_us(lead(ts, 1, {ASOF}) OVER (ORDER BY ts, event_id)) - epoch_us(ts) AS us FROM events) SELECT event_type AS kind, round(sum(us) / 1000000.0, 6) AS seconds, count(*) AS turns FROM h GROUP BY ALL")
def time_in_state(spark, sf_dir):
    rows = one_series(spark, sf_dir)
    return split.durations(rows, [], "kind", asof(rows), order=("event_id",)).select("kind", F.round("seconds", 6).alias("seconds"), "turns")


@query("WITH p AS (SELECT value, row_number() OVER (ORDER BY ts, event_id) AS i, count(*) OVER () AS n FROM events), a AS (SELECT max(n) AS n, avg(value) FILTER (i > floor(n / 2)) - avg(value) FILTER (i <= floor(n / 2)) AS d FROM p) SELECT n, round(d, 8) AS change, CASE WHEN n < 4 THEN NULL WHEN d > 0.2 THEN 'up' WHEN d < -0.2 THEN 'down' ELSE 'flat' END AS trend FROM a")
def long_half_trend(spark, sf_dir):
    return split.half_trend(one_series(spark, sf_dir), [], "value", order=("event_id",)).select("n", r8("change").alias("change"), "trend")


@query("""WITH RECURSIVE n AS (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) AS i FROM events WHERE event_type = 'click' AND user_id % 10 = 3), r AS (SELECT i, event_id, value AS y FROM n WHERE i = 1 UNION ALL SELECT n.i, n.event_id, r.y * (1 - 0.05) + n.value * 0.05 FROM r JOIN n ON n.i = r.i + 1) SELECT event_id, round(y, 6) AS smooth FROM r""")
def smoothed_series(spark, sf_dir):
    """One smoothed series of the boats whose number ends in 3."""
    rows = events(spark, sf_dir).filter("kind = 'click' and user % 10 = 3")
    return split.smoothed(rows, [], "value", 0.05, "smooth", order=("event_id",), bucket="1 day").select("event_id", F.round("smooth", 6).alias("smooth"))


_STATES = f"""
WITH p AS (
    SELECT user_id, ts, event_id, CASE WHEN value > 60 THEN 'pending' ELSE 'normal' END AS state FROM events WHERE ts <= {ASOF}
), l AS (
    SELECT *, lag(state) OVER w AS was, lag(ts) OVER w AS before, max(ts) OVER (PARTITION BY user_id) AS final FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), t AS (
    SELECT * FROM l WHERE was IS NULL OR was <> state OR ts > before + INTERVAL 24 HOUR
), s AS (
    SELECT user_id, state, ts, lead(ts) OVER w AS nxt, coalesce(lead(before) OVER w, final) AS seen FROM t WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), e AS (
    SELECT user_id, state, ts FROM s
    UNION ALL SELECT user_id, 'firing', ts + INTERVAL 4 HOUR FROM s WHERE state = 'pending' AND ts + INTERVAL 4 HOUR <= least(coalesce(nxt, {ASOF}), seen + INTERVAL 24 HOUR)
    UNION ALL SELECT user_id, 'nodata', seen + INTERVAL 24 HOUR FROM s WHERE seen + INTERVAL 24 HOUR < nxt OR (nxt IS NULL AND seen + INTERVAL 24 HOUR <= {ASOF})
)
SELECT user_id AS "user", state, {STAMP.format('ts')} AS at FROM e
"""


@query(_STATES)
def alert_states(spark, sf_dir):
    """Normal, pending, firing after four hours, and no data after a day of silence, for each boat."""
    rows = events(spark, sf_dir)
    found = alerts.states(rows, ["user"], F.col("value") > 60, "4 hours", "24 hours", asof(rows), ("event_id",))
    return found.select("user", "state", stamp("time").alias("at"))


def _spans(kind: str, test: str) -> str:
    return (
        f"(SELECT user_id, ts AS since, nxt AS ended FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nxt FROM (SELECT *, lag(bad, 1, false) OVER (PARTITION BY user_id ORDER BY ts) AS was FROM "
        f"(SELECT user_id, ts, value {test} AS bad FROM events WHERE event_type = '{kind}')) WHERE bad <> was) WHERE bad)"
    )


@query(f"""
WITH a AS {_spans('click', '< 60')}, b AS {_spans('view', '> 10')}, ab AS (
    SELECT a.user_id, greatest(a.since, b.since) AS since, least(coalesce(a.ended, {ASOF}), coalesce(b.ended, {ASOF})) AS ended FROM a JOIN b USING (user_id)
)
SELECT user_id AS "user", 'low_and_windy' AS uid, {STAMP.format('since')} AS since, {STAMP.format('since + INTERVAL 180 SECOND')} AS fires, {STAMP.format('ended')} AS ended FROM ab WHERE since < ended AND since + INTERVAL 180 SECOND <= ended
""")
def alert_conjunction(spark, sf_dir):
    """Two conditions on two measurements that hold at once for three minutes, for each boat."""
    rows = events(spark, sf_dir)
    points = rows.select("time", "user", F.col("kind").alias("measurement"), F.col("value").alias("value_double"))
    rule = alerts.Conjunction("low_and_windy", (("click", "<", 60.0), ("view", ">", 10.0)), 180)
    found = alerts.together(points, ["user"], rule, asof(rows))
    return found.select("user", "uid", stamp("since").alias("since"), stamp("fires").alias("fires"), stamp("ended").alias("ended"))


_DEG = "radians(value * 7 % 360)"


@query(f"""WITH m AS (SELECT event_id, avg(sin({_DEG})) OVER w AS s, avg(cos({_DEG})) OVER w AS c FROM events WHERE event_type = 'view' WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '5 days 23 hours 59 minutes 59.999999 seconds' PRECEDING AND CURRENT ROW)), d AS (SELECT event_id, degrees(sqrt(-2 * ln(least(sqrt(s * s + c * c), 1.0)))) AS spread FROM m) SELECT event_id, round(spread, 5) AS spread FROM d WHERE spread > 40""")
def rolling_spread(spark, sf_dir):
    """Directions whose circular spread over the six days before is above 40 degrees, for each boat."""
    points = events(spark, sf_dir).select("event_id", "time", "user", F.col("kind").alias("measurement"), (F.col("value") * 7 % 360).alias("value_double"))
    return alerts.unsteady_rolling(points, "view", "6 days", 40.0, ["user"]).select("event_id", F.round("spread", 5).alias("spread"))


_RATIO = " UNION ALL ".join(
    f"SELECT user_id AS \"user\", '{uid}' AS uid, {STAMP.format('since')} AS since, {STAMP.format('ended')} AS ended FROM (SELECT user_id, ts AS since, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ended, bad FROM (SELECT *, lag(bad, 1, false) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM (SELECT user_id, ts, event_id, value / (20 + user_id % 40) {test} {limit} AS bad FROM events)) WHERE bad <> was) WHERE bad AND since + to_seconds({hold}) <= coalesce(ended, {ASOF})"
    for uid, test, limit, hold in alerts.RATIOS
)


@query(_RATIO)
def polar_ratio_alerts(spark, sf_dir):
    """Speed below 85, above 105 and below 80 per cent of its target, each for its hold."""
    rows = events(spark, sf_dir).withColumn("target", (20 + F.col("user") % 40).cast("double"))
    found = alerts.ratios(rows, ["user"], "value", "target", asof(rows), ("event_id",))
    return found.select("user", "uid", stamp("since").alias("since"), stamp("ended").alias("ended"))


@query(f"""WITH w AS (SELECT event_type AS kind, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS t, avg(value) AS v FROM events WHERE ts >= {ASOF} - INTERVAL 3 DAY AND ts < {ASOF} GROUP BY ALL), g AS (SELECT kind, unnest(generate_series(time_bucket(INTERVAL 1 HOUR, {ASOF} - INTERVAL 3 DAY) + INTERVAL 1 HOUR, time_bucket(INTERVAL 1 HOUR, {ASOF} - INTERVAL 1 MICROSECOND) + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS t FROM (SELECT DISTINCT kind FROM w)) SELECT g.kind, {STAMP.format('g.t')} AS closed, round(w.v, 8) AS mean FROM g LEFT JOIN w ON g.kind = w.kind AND g.t = w.t""")
def range_mean_gapfill(spark, sf_dir):
    """Hourly means of the last three days, every hour of the range for each kind."""
    rows = events(spark, sf_dir)
    now = asof(rows)
    found = Series(rows, ("kind",)).filled_windows("1 hour", "mean", now - F.expr("interval 3 days"), now)
    return found.select("kind", stamp("time").alias("closed"), r8("value").alias("mean"))


@query(f"""WITH p AS (SELECT event_type AS m, ts, value AS v FROM events WHERE ts < {ASOF} AND ts >= {ASOF} - INTERVAL 10 DAY) SELECT 'last_click' AS panel, round(arg_max(v, ts), 6) AS value FROM p WHERE m = 'click' UNION ALL SELECT 'first_click', round(arg_min(v, ts), 6) FROM p WHERE m = 'click' UNION ALL SELECT 'sum_view', round(sum(v), 6) FROM p WHERE m = 'view' UNION ALL SELECT 'min_view', min(v) FROM p WHERE m = 'view' UNION ALL SELECT 'max_error', max(v) FROM p WHERE m = 'error' UNION ALL SELECT 'mean_error', round(avg(v), 6) FROM p WHERE m = 'error' UNION ALL SELECT 'n_signup', count(*) FROM p WHERE m = 'signup' UNION ALL SELECT 'range_signup', round(max(v) - min(v), 6) FROM p WHERE m = 'signup'""")
def panel_reducers(spark, sf_dir):
    rows = events(spark, sf_dir)
    points = rows.select("time", F.col("kind").alias("measurement"), F.col("value").alias("value_double"))
    wanted = {
        "last_click": ("click", "lastNotNull"), "first_click": ("click", "firstNotNull"), "sum_view": ("view", "sum"), "min_view": ("view", "min"), "max_error": ("error", "max"), "mean_error": ("error", "mean"), "n_signup": ("signup", "count"), "range_signup": ("signup", "range"),
    }
    return panels.reduced(points, asof(rows), wanted, "10 days").select("panel", F.round("value", 6).alias("value"))


def _shift_sql() -> str:
    kinds = {"click": ("up_two_days", 172_800, "x - f > 20"), "view": ("either_day", 86_400, "abs(x - f) > 40"), "error": ("turn_three_days", 259_200, "abs((x - f + 540) % 360 - 180) > 90")}
    each = []
    for kind, (uid, seconds, hit) in kinds.items():
        change = "x - f" if "%" not in hit else "(x - f + 540) % 360 - 180"
        each.append(f"SELECT event_id, '{uid}' AS uid, round({change}, 4) AS change FROM (SELECT event_id, value AS x, first_value(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN to_seconds({seconds}) PRECEDING AND CURRENT ROW) AS f FROM events WHERE event_type = '{kind}') WHERE {hit}")
    return " UNION ALL ".join(each)


@query(_shift_sql())
def alert_shifts(spark, sf_dir):
    """Three rules over changes in one pass: upwards, either way, and on the circle."""
    points = events(spark, sf_dir).select("event_id", "time", "user", F.col("kind").alias("measurement"), F.col("value").alias("value_double"))
    rules = [alerts.Shift("up_two_days", "click", 172_800, 20.0, "up"), alerts.Shift("either_day", "view", 86_400, 40.0), alerts.Shift("turn_three_days", "error", 259_200, 90.0, angle=True)]
    found = alerts.shifted(points, rules, ["user"])
    at = points.select("event_id", "user", "time", "measurement")
    names = {r.uid: r.measurement for r in rules}
    own = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return found.withColumn("measurement", own[F.col("uid")]).join(at, ["user", "time", "measurement"]).select("event_id", "uid", "change")


_MV = "CAST(floor(value * 100) AS BIGINT) % 16000"


@query(f"SELECT user_id AS device, {STAMP.format('ts')} AS at, round({_MV} / 1000.0, 3) AS volts, round((event_id % 20000 - 9000) / 1000000.0, 6) AS amperes, CAST(event_id % 101 AS INTEGER) AS soc, CAST(event_id % 1000 AS INTEGER) AS cycles FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0")
def battery_status(spark, sf_dir):
    """Each event as a status frame in two chunks; every seventh has a wrong checksum, every eleventh lacks its second chunk."""
    e = F.col("event_id")
    le = lambda v, n: [F.shiftright(v.cast("long"), 8 * k).bitwiseAND(F.lit(255)) for k in range(n)]
    body = F.array(F.lit(0xCC).cast("long"), F.lit(0xF0).cast("long"), *le(F.floor(F.col("value") * 100) % 16000, 3), *le(e % 20000 - 9000, 3), *le(F.lit(40), 3), *le(F.lit(-5), 3), *le(e % 1000, 2), *le(e % 101, 2))
    text = lambda xs: F.array_join(F.transform(xs, lambda x: F.lpad(F.hex(x), 2, "0")), "")
    check = battery.crc8(F.transform("body", lambda x: x.cast("int"))).cast("long")
    rows = events(spark, sf_dir).withColumn("body", body).withColumn("digits", text(F.concat("body", F.array(F.when(e % 7 == 0, check.bitwiseXOR(F.lit(1))).otherwise(check)))))
    cut = F.when(e % 11 == 0, F.array(F.substring("digits", 1, 24))).otherwise(F.array(F.substring("digits", 1, 24), F.substring("digits", 25, 99)))
    chunks = rows.select(F.col("user").alias("device"), "time", F.posexplode(cut).alias("seq", "hex")).select("device", "time", "seq", F.unhex("hex").alias("data"))
    found = battery.readings(battery.frames(chunks, bucket="1 day"))
    return found.select("device", stamp("time").alias("at"), F.round("voltage_v", 3).alias("volts"), F.round("current_a", 6).alias("amperes"), F.col("soc_pct").alias("soc"), "cycles")


_MINUTES = "round(abs({0}) * 60, 4)"
_COORDINATE = "printf('%0{1}d%07.4f', CAST(floor({0} / 60) AS BIGINT), round({0} - floor({0} / 60) * 60, 4))"


@query(f"""WITH p AS (SELECT event_id, ts, value % 80 - 40 AS lat, value * 3 % 360 - 180 AS lon, event_id % 200 / 10.0 AS knots, event_id % 3600 / 10.0 AS deg FROM events), m AS (SELECT *, {_MINUTES.format('lat')} AS a, {_MINUTES.format('lon')} AS o FROM p), b AS (SELECT event_id, 'IIRMC,' || strftime(ts, '%H%M%S') || ',A,' || {_COORDINATE.format('a', 2)} || CASE WHEN lat < 0 THEN ',S,' ELSE ',N,' END || {_COORDINATE.format('o', 3)} || CASE WHEN lon < 0 THEN ',W,' ELSE ',E,' END || printf('%.1f', knots) || ',' || printf('%.1f', deg) || ',' || strftime(ts, '%d%m%y') || ',,' AS body FROM m)
SELECT event_id, '$' || body || '*' || printf('%02X', list_reduce([ascii(c) for c in string_split(body, '')], lambda x, y: xor(x, y))) AS line FROM b""")
def course_sentences(spark, sf_dir):
    """Each event as a sentence of place, speed and course over ground, with its checksum."""
    v, e = F.col("value"), F.col("event_id")
    line = sinks.course_sentence(F.col("time"), v % 80 - 40, v * 3 % 360 - 180, e % 200 / 10, e % 3600 / 10)
    return events(spark, sf_dir).select("event_id", line.alias("line"))
