import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from brightwake.operators import joins, rolling
from brightwake.operators.series import Series, as_map, latest
from brightwake.plans import alerts, tools
from brightwake.sources import points as P

T0 = dt.datetime(2026, 5, 1, 12)


def at(s):
    return T0 + dt.timedelta(seconds=s)


@pytest.fixture(scope="module")
def numbers(spark):
    rows = [(at(i), "wind", float(i)) for i in range(0, 600, 10)] + [(at(i), "roll", 0.5 if 100 <= i < 400 else 0.1) for i in range(0, 600, 20)]
    return spark.createDataFrame(rows, "time timestamp, measurement string, value_double double")


def test_range_is_open_at_its_end(numbers):
    s = Series(numbers, value="value_double").measurement("wind").range(F.lit(at(100)), "50 seconds")
    assert [r["value_double"] for r in s.df.orderBy("time").collect()] == [50.0, 60.0, 70.0, 80.0, 90.0]


def test_empty_group_gives_no_row_and_filled_windows_do(numbers):
    s = Series(numbers, value="value_double").measurement("none")
    assert s.aggregate("count").count() == 0
    gap = Series(numbers.filter("time < timestamp'2026-05-01 12:01:00' or time >= timestamp'2026-05-01 12:05:00'"), value="value_double").measurement("wind")
    filled = gap.filled_windows("1 minute", "count").orderBy("time").collect()
    assert [r["value_double"] for r in filled[:6]] == [6, 0, 0, 0, 0, 6]
    assert gap.windows("1 minute").count() < len(filled)


def test_latest_and_map(numbers):
    assert tuple(latest(numbers, {"w": "wind", "r": "roll", "x": "none"}, value="value_double").first()) == (590.0, 0.1, None)
    assert as_map(numbers, value="value_double").first()[0] == {"wind": 590.0, "roll": 0.1}


def test_latest_stays_a_hash_aggregate(numbers):
    plan = latest(numbers, {"w": "wind", "r": "roll"}, value="value_double")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_asof_forms_agree(spark):
    ticks = spark.createDataFrame([("a", at(s)) for s in (5, 10, 4000, 90000)] + [("b", at(7))], "k string, time timestamp")
    readings = spark.createDataFrame([("a", at(10), 1.0), ("a", at(3000), 2.0), ("a", at(5000), 3.0)], "k string, time timestamp, value double")
    one = sorted(map(tuple, joins.asof(ticks, readings, ["k"]).select("k", "time", "value").collect()))
    two = sorted(map(tuple, joins.asof_bucketed(ticks, readings, ["k"], "hour").select("k", "time", "value").collect()))
    assert one == two and [r[2] for r in one] == [None, 1.0, 2.0, 3.0, None]


def test_polar_knots_middles_and_ends(spark):
    df = spark.createDataFrame([(x,) for x in (2.0, 5.0, 5.5, 11.0, 24.999, 25.0, 40.0)], "w double")
    found = {r["w"]: r["upwind"] for r in joins.interpolated(df, "w", P.polar(spark), "tws", ["upwind"]).collect()}
    assert found[2.0] == 3.2 and found[5.0] == 3.2 and found[5.5] == pytest.approx(3.55) and found[11.0] == pytest.approx(6.95) and found[40.0] == 12.0 and found[25.0] == 12.0
    values = [found[k] for k in sorted(found)]
    assert values == sorted(values)


def test_threshold_rules(spark, numbers):
    rules = [alerts.Rule("high", "roll", ">", 0.4, 600, 120, "critical"), alerts.Rule("low", "roll", "<", 0.4, 600, 1, "info")]
    assert [r["uid"] for r in alerts.firing(numbers, F.lit(at(600)), rules).collect()] == ["low"]
    assert [r["uid"] for r in alerts.firing(numbers, F.lit(at(300)), rules).collect()] == ["high"]
    (held,) = alerts.held(numbers, rules[0]).collect()
    assert held["since"] == at(100) and held["fires"] == at(220) and held["ended"] == at(400)
    assert alerts.held(numbers, alerts.Rule("slow", "roll", ">", 0.4, 600, 400, "info")).count() == 0


def test_shifts_on_the_circle(spark):
    rows = [(at(0), "environment.wind.directionTrue", 355.0), (at(60), "environment.wind.directionTrue", 2.0), (at(120), "environment.wind.directionTrue", 12.0)]
    df = spark.createDataFrame(rows, "time timestamp, measurement string, value_double double")
    found = {(r["uid"], r["time"]): r["change"] for r in alerts.shifted(df).collect()}
    assert found["w_a1_wind_shift", at(120)] == 17.0 and ("pe_e2_unfavorable_header", at(120)) not in found and found["pe_e1_favorable_lift", at(120)] == 17.0


def test_silence_includes_what_was_never_seen(spark, numbers):
    found = {r["measurement"] for r in alerts.silent(numbers, F.lit(at(600)), [("wind", 30), ("roll", 5), ("sonar", 60)]).collect()}
    assert found == {"roll", "sonar"}


def test_oscillation_and_waves(spark):
    rows = [("a", at(i), (10 + 8 * math.sin(2 * math.pi * i / 600)) % 360) for i in range(0, 6000, 20)]
    df = spark.createDataFrame(rows, "boat string, time timestamp, value_double double")
    (r,) = alerts.oscillation(df, ["boat"]).collect()
    assert r["period_seconds"] == pytest.approx(600, rel=0.05) and r["share"] > 0.8
    w = 2 * math.pi / 8
    acc = spark.createDataFrame([("a", T0 + dt.timedelta(seconds=i / 10), -1.0 * w * w * math.sin(w * i / 10)) for i in range(6000)], "boat string, time timestamp, value_double double")
    assert alerts.wave_height(acc, ["boat"]).first()["height"] == pytest.approx(4 / math.sqrt(2), rel=0.05)


def test_smoothing_and_trends(spark):
    df = spark.createDataFrame([("a", at(i), v) for i, v in enumerate([1.0, 1.0, 2.0, 3.0])], "k string, time timestamp, value double")
    last = rolling.smoothed(df, ["k"], "value", 0.5, "s").orderBy(F.desc("time")).first()
    assert last["s"] == pytest.approx(2.25)
    assert rolling.half_trend(df, ["k"], "value").first()["trend"] == "up"
    assert rolling.half_trend(df.limit(3), ["k"], "value").first()["trend"] is None


def test_tools_with_nothing_to_read(spark):
    empty = spark.createDataFrame([], P.POINT)
    now = F.lit(T0)
    for name, tool in (tools.NUMERIC | tools.TEXT | tools.MIXED).items():
        assert tool(empty, now).count() <= 12, name
    assert tools.get_crew_workload(empty, now).first()["level"] == "moderate"
    assert tools.get_race_start(empty, now).first()["signal_sequence"] == "No start time set"


def test_zero_is_a_value(spark):
    df = spark.createDataFrame([(at(0), tools.HDG, "value", 0.0, None, None, None, {})], P.POINT)
    assert tools.get_heading(df, F.lit(at(60))).first()["heading_degrees"] == 0.0


def test_smoothing_takes_all_rows_of_a_series(spark):
    rows = [(k, i, None if k == "n" and i % 3 else 100.0 if i < 700 else 0.0) for k in "an" for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, time long, value double").repartition(7)
    last = {r["k"]: r["s"] for r in rolling.smoothed(df, ["k"], "value", 0.001, "s").filter("time = 999").collect()}
    assert abs(last["a"] - 100 * 0.999**300) < 1e-9 and abs(last["n"] - 100 * 0.999**100) < 1e-9
    assert rolling.smoothed(df, [], "value", 0.5, "s").count() == 2000


def test_shift_on_the_circle_keeps_the_remainders_sign(spark):
    df = spark.createDataFrame([(at(0), "m", 600.0), (at(60), "m", 10.0), (at(120), "m", 250.0)], "time timestamp, measurement string, value_double double")
    found = {r["time"]: r["change"] for r in alerts.shifted(df, [alerts.Shift("turn", "m", 600, 90.0, angle=True)]).collect()}
    assert found == {at(60): math.fmod(10 - 600 + 540, 360) - 180}  # 250 - 600 + 540 - 180 is 10
