"""Functions and streams that the other files don't reach."""

import datetime as dt
import json
import math
import time

import pytest
from pyspark.sql import functions as F

from brightwake.functions import angles, classify, nautical, units
from brightwake.plans import alerts
from brightwake.sources import feeds, sinks
from brightwake.sources import points as P
from brightwake.streaming import jobs

T0 = dt.datetime(2026, 5, 1, 12)
SCHEMA = "time timestamp, k string, value double"


@pytest.fixture(scope="module")
def one(spark):
    return lambda *cs: tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cs))).first())


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_angles_and_motion(one):
    lit = F.lit
    assert one(angles.fold_pi(lit(3.5)), angles.fold_pi(lit(-3.5)), angles.fold_pi(lit(1.0))) == pytest.approx((3.5 - 2 * math.pi, 2 * math.pi - 3.5, 1.0))
    assert one(angles.mounted(lit(10.0), lit(2.0), lit(True)), angles.mounted(lit(10.0), lit(2.0), lit(False)), angles.mounted(lit(None).cast("double"), lit(2.0), lit(True))) == (-8.0, 12.0, None)
    assert one(nautical.leeway(lit(5.0), lit(355.0)), nautical.vmg_to_wind(lit(6.0), lit(math.pi / 3))) == pytest.approx((10.0, 3.0))
    assert one(nautical.calibrated(lit(12.0), 2.0, 0.5), nautical.polynomial(lit(2.0), [1.0, -3.0, 0.5]), nautical.polynomial(lit(2.0), [])) == (5.0, -3.0, 0.0)
    assert one(units.degrees_per_minute(lit(0.1)), units.nautical_miles(lit(926.0))) == pytest.approx((343.7758, 0.5), abs=1e-3)
    assert one(units.fixed(lit(2.0), 1), units.fixed(lit(None).cast("double"), 1)) == ("2.0", None)
    assert one(classify.helm_overdue(lit(7199.0)), classify.helm_overdue(lit(7200.0))) == (False, True)


def test_classes_at_their_bounds(one):
    assert one(*(classify.wind_class(F.lit(x)) for x in (3.9, 4.0, 11.9, 12.0, 19.9, 20.0))) == ("very_light", "light", "moderate", "fresh", "strong", "gale")
    assert one(*(classify.boat_mode(F.lit(a), F.lit(b)) for a, b in ((0.0, 44.0), (0.0, 315.0), (10.0, 200.0), (350.0, 80.0)))) == ("upwind", "reaching", "downwind", "reaching")


def test_points_and_dimensions_on_disk(spark, tmp_path):
    rows = [(T0, "wind.speed", "value", 5.0, None, None, "a", {"user": "1"}), (at(1), "wind.angle", "value", None, "x", None, None, None), (at(2), "wind.speed", "value", 6.0, None, None, "a", {})]
    P.write(spark.createDataFrame(rows, P.POINT), str(tmp_path / "points"))
    P.write(spark.createDataFrame(rows[:1], P.POINT), str(tmp_path / "points"))
    back = P.read(spark, str(tmp_path / "points"))
    assert back.filter("measurement = 'wind.speed'").count() == 3 and back.filter("measurement = 'wind.angle'").first()["value_string"] == "x"
    assert "PartitionFilters: [isnotnull(measurement" in back.filter("measurement = 'wind.speed'")._jdf.queryExecution().toString()
    names = ["tws", "upwind", "reach", "downwind", "upwind_angle", "downwind_angle"]
    path = tmp_path / "polar.json"
    path.write_text(json.dumps({"name": "x", "polars": [dict(zip(names, row, strict=True)) for row in reversed(P.POLAR)]}, indent=1))
    assert [tuple(r) for r in P.polar_from_json(spark, str(path)).collect()] == sorted(P.POLAR)
    path.write_text(json.dumps({"polars": [{"tws": 5.0}]}))
    with pytest.raises(ValueError, match="upwind"):
        P.polar_from_json(spark, str(path))
    assert P.buoys(spark).count() == 3 and units.registry(spark).filter("unit = 'knots'").count() == 6


def test_csv_by_series(spark, tmp_path):
    rows = [(at(i * 7 % 20), "ab"[i % 2], float(i)) for i in range(20)]
    sinks.export_csv(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "out"), ["k"], "time")
    files = [f.read_text().splitlines() for f in sorted((tmp_path / "out").glob("part-*.csv")) if f.stat().st_size]
    lines = [x.split(",") for f in files for x in f[1:]]
    assert all(f[0] == "time,k,value" for f in files) and len(lines) == 20
    for f in files:
        cells = [x.split(",") for x in f[1:]]
        assert [(c[1], c[0]) for c in cells] == sorted((c[1], c[0]) for c in cells)


def test_spreads_and_disagreement(spark):
    wide = [(at(i * 60), "wind", float((i * 97) % 360)) for i in range(10)] + [(at(600 + i * 60), "wind", 90.0 + i % 2) for i in range(10)]
    points = spark.createDataFrame(wide, "time timestamp, measurement string, value_double double")
    assert [r["time"] for r in alerts.unsteady(points, "wind", "10 minutes", 20.0).collect()] == [at(600)]
    slope = alerts.trend_of_spread(points.withColumn("k", F.lit(1)), "wind", "10 minutes", ["k"]).first()
    assert slope["windows"] == 2 and slope["slope_per_hour"] < 0
    buoy = spark.createDataFrame([(at(30), 91.0), (at(700), 350.0)], "time timestamp, value_double double")
    boat = spark.createDataFrame([(at(10), 89.0), (at(20), 91.0), (at(800), 12.0)], "time timestamp, value_double double")
    found = [(r["time"], round(r["apart"], 6)) for r in alerts.disagreeing(boat, buoy).collect()]
    assert found == [(at(1200), 22.0)]


def stream(spark, folder, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).parquet(str(folder))


def drain(frame, checkpoint, mode="append"):
    out = []
    frame.writeStream.outputMode(mode).foreachBatch(lambda b, n: out.extend(b.collect())).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination(120)
    return out


def test_downsampled_and_restart_from_the_checkpoint(spark, tmp_path):
    rows = [(at(i / 4), "ab"[i % 2], float(i)) for i in range(200)]
    live = drain(jobs.downsampled(stream(spark, tmp_path / "in", rows), ["k"], "1 second", "2 seconds"), tmp_path / "cp")
    # A second start reads what has come since, and knows the windows that the first one left open.
    more = [(at(50 + i / 4), "ab"[i % 2], float(200 + i)) for i in range(200)]
    live += drain(jobs.downsampled(stream(spark, tmp_path / "in", more), ["k"], "1 second", "2 seconds"), tmp_path / "cp")
    got = {(r["time"], r["k"]): r["value"] for r in live}
    want = {}
    for t, k, v in rows + more:
        want[(at(math.floor((t - T0).total_seconds()) + 1), k)] = v
    assert len(live) == len(got) and got.items() <= want.items() and {k for k in want if k[0] <= at(96)} <= set(got)


def test_sentences_on_a_stream(spark, tmp_path):
    lines = [("$HEATT,1.0,2.0,3.0*00",), ("$GPGGA,1",), ("$HEATT,x,2,3",)]
    found = drain(feeds.attitude(stream(spark, tmp_path / "in", lines, "line string")), tmp_path / "cp")
    assert [round(r["roll"], 6) for r in found] == [round(math.radians(1), 6)]


def test_smoothing_on_a_stream_goes_on_after_a_missing_value(spark, tmp_path):
    rows = [(at(0), "a", None), (at(1), "a", 10.0), (at(2), "a", None), (at(3), "a", 20.0), (at(4), "a", float("nan")), (at(5), "a", 20.0)]
    found = sorted(drain(jobs.smoothed_stream(stream(spark, tmp_path / "in", rows), "k", 0.5), tmp_path / "cp"), key=lambda r: r["time"])
    assert [(r["time"], r["value"]) for r in found] == [(at(1), 10.0), (at(3), 15.0), (at(5), 17.5)]


def test_heartbeat_says_the_last_value_again(spark, tmp_path):
    out = []
    frame = jobs.heartbeat(stream(spark, tmp_path / "in", [(at(i), "ab"[i % 2], float(i)) for i in range(6)]), "k", 1)
    q = frame.writeStream.outputMode("append").foreachBatch(lambda b, n: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    until = time.time() + 60
    while time.time() < until and {(r["k"], r["fresh"]) for r in out} != {("a", True), ("a", False), ("b", True), ("b", False)}:
        time.sleep(0.3)
    q.stop()
    assert {(r["k"], r["value"]) for r in out} == {("a", 4.0), ("b", 5.0)} and any(not r["fresh"] for r in out)


def test_ticks_write_a_folder_each(spark, tmp_path):
    inputs = spark.createDataFrame([(1.0,), (3.0,)], "value double")
    q = jobs.ticks(spark.readStream.format("rate").option("rowsPerSecond", 5).load(), lambda batch: inputs.agg(F.avg("value").alias("mean")), str(tmp_path / "out"), str(tmp_path / "cp"), "500 milliseconds")
    until = time.time() + 60
    while time.time() < until and len(list((tmp_path / "out").glob("tick=*/_SUCCESS"))) < 2:
        time.sleep(0.3)
    q.stop()
    done = [f.parent for f in (tmp_path / "out").glob("tick=*/_SUCCESS")]
    assert len(done) >= 2 and all(spark.read.parquet(str(d)).first()["mean"] == 2.0 for d in done)
