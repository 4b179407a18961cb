import datetime as dt

import pytest
from pyspark.sql import functions as F

from brightwake.operators.series import Series
from brightwake.streaming import jobs

T0 = dt.datetime(2026, 5, 1, 12)
SCHEMA = "time timestamp, k string, value double"


@pytest.fixture()
def source(spark, tmp_path):
    rows = [(T0 + dt.timedelta(seconds=i), "ab"[i % 2], float(i % 50)) for i in range(300)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    return lambda: spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))


def drain(stream, tmp_path, mode="append"):
    out = []
    q = stream.writeStream.outputMode(mode).foreachBatch(lambda b, n: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return out


def test_windows_as_in_batch(spark, source, tmp_path):
    live = drain(jobs.window_means(source(), ["k"], "1 minute", "1 second"), tmp_path)
    batch = Series(spark.read.schema(SCHEMA).parquet(str(tmp_path / "in")), ("k",)).windows("1 minute").collect()
    a, b = ({(r["time"], r["k"]): round(r["value"], 9) for r in x} for x in (live, batch))
    assert a and a.items() <= b.items()


def test_latest_values(spark, source, tmp_path):
    live = {r["k"]: r["value"] for r in drain(jobs.latest_values(source(), ["k"]), tmp_path, "update")}
    assert live == {"a": 48.0, "b": 49.0}


def test_held_alerts_fire_once_a_stretch(spark, source, tmp_path):
    found = drain(jobs.held_alerts(source(), "k", 20.0, 10), tmp_path)
    assert len(found) == 12 and all((r["fired"] - r["since"]).total_seconds() >= 10 for r in found)


def test_throttle_and_once(spark, source, tmp_path):
    rare = drain(jobs.throttled(source().filter("value > 45"), "k", 100), tmp_path)
    assert 2 <= len(rare) <= 6
    assert {r["k"] for r in drain(jobs.once(source(), "k"), tmp_path / "o")} == {"a", "b"}


def test_history_and_smoothing(spark, source, tmp_path):
    assert len(drain(jobs.history(source(), "k", 1), tmp_path)) == 300
    assert len(drain(jobs.smoothed_stream(source(), "k"), tmp_path / "s")) == 300


def test_append_is_idempotent(spark, source, tmp_path):
    jobs.appended(source(), str(tmp_path / "out"), str(tmp_path / "cp2")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 300
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("value")).first()[0] == sum(i % 50 for i in range(300))


def test_missing_values_are_no_breach(spark, tmp_path):
    rows = [(T0 + dt.timedelta(seconds=i), "gone", None) for i in range(60)] + [(T0 + dt.timedelta(seconds=i), "high", None if i == 15 else 99.0) for i in range(30)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    found = drain(jobs.held_alerts(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), "k", 20.0, 10), tmp_path)
    assert sorted((r["k"], (r["since"] - T0).total_seconds()) for r in found) == [("high", 0.0), ("high", 16.0)]
