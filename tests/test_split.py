"""Series cut into buckets against the forms over whole series, and against plain loops."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightwake.operators import rolling, split
from brightwake.streaming import stateful

T0 = dt.datetime(2026, 5, 1, 11, 59)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def series(spark):
    """Two series and one without a key; gaps of many buckets, rows on the borders, nulls."""
    rng = random.Random(11)
    rows, s, i = [], 0, 0
    for k in ("a", "b", None):
        s = 0
        for _ in range(400):
            s += rng.choice([1, 7, 60, 61, 300, 3600, 40_000] if rng.random() < 0.2 else [1, 10, 60])
            rows.append((i, k, at(s), None if rng.random() < 0.1 else round(rng.uniform(-3, 3), 3), rng.choice("xyz")))
            i += 1
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "i int, k string, time timestamp, value double, who string").repartition(5).cache()


def rows_of(df, *names):
    return sorted((tuple(round(x, 8) if isinstance(x, float) else x for x in (r[n] for n in names)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("by", [["k"], []])
@pytest.mark.parametrize("bucket", [None, "1 minute", "1 day"])
def test_moving(series, by, bucket):
    """Inclusive: as the whole form; strict: without what is exactly the interval back."""
    df = series if by else series.filter("k = 'a'")
    found = split.moving(df, by, {"m": F.avg("value"), "n": F.count(F.lit(1))}, "5 minutes", False, bucket=bucket)
    whole = rolling.moving(rolling.moving(df.withColumn("one", F.lit(1)), by, "value", "5 minutes", "m"), by, "one", "5 minutes", "n", "count")
    assert rows_of(found, "i", "m", "n") == rows_of(whole, "i", "m", "n")
    strict = {r["i"]: r["n"] for r in split.moving(df, by, {"n": F.count(F.lit(1))}, "5 minutes", True, bucket=bucket).collect()}
    all_rows = df.collect()
    for r in all_rows:
        assert strict[r["i"]] == sum(1 for q in all_rows if (not by or q["k"] == r["k"]) and r["time"] - dt.timedelta(minutes=5) < q["time"] <= r["time"])


@pytest.mark.parametrize("bucket", ["1 minute", "1 hour", "1 day"])
def test_carried_states(series, bucket):
    asof = F.lit(at(10_000_000))
    assert rows_of(split.records(series, ["k"], "value", 0.5, bucket=bucket), "i", "previous_best") == rows_of(rolling.records(series, ["k"], "value", 0.5), "i", "previous_best")
    assert rows_of(split.durations(series, ["k"], "who", asof, bucket=bucket), "k", "who", "seconds", "turns") == rows_of(rolling.durations(series, ["k"], "who", asof), "k", "who", "seconds", "turns")
    assert rows_of(split.half_trend(series, ["k"], "value", bucket=bucket), "k", "n", "change", "trend") == rows_of(rolling.half_trend(series, ["k"], "value"), "k", "n", "change", "trend")


@pytest.mark.parametrize("bucket", ["1 minute", "1 day"])
def test_smoothing_and_high_pass(series, bucket):
    assert rows_of(split.smoothed(series, ["k"], "value", 0.2, "y", bucket=bucket), "i", "y") == rows_of(rolling.smoothed(series, ["k"], "value", 0.2, "y"), "i", "y")
    own = sorted((r for r in series.filter("k = 'a' and value is not null").collect()), key=lambda r: r["time"])
    want = stateful.high_passed(np.array([r["value"] for r in own]), 1 / (1 + 2 * np.pi * 0.05 / 10))
    found = {r["i"]: r["y"] for r in split.high_passed(series.filter("k = 'a'"), [], "value", 0.05, 10.0, "y", bucket=bucket).collect()}
    assert len(found) == len(own) and all(abs(found[r["i"]] - y) < 1e-9 for r, y in zip(own, want, strict=True))


def test_one_series_spreads_over_tasks(spark):
    """A series of a million rows and no keys: no task sorts more than a few buckets of it."""
    df = spark.range(1_000_000).select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("time"), (F.col("id") % 97).cast("double").alias("value"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = split.moving(df, [], {"m": F.avg("value")}, "5 minutes").withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in found) == 1_000_000 and len(found) == 4 and max(r["count"] for r in found) < 400_000


def test_wave_heights_as_on_the_stream(spark):
    rng = np.random.default_rng(5)
    heave = np.sin(np.arange(1500) / 10 * 2 * np.pi / 7) + rng.normal(0, 0.1, 1500)
    df = spark.createDataFrame([("a", dt.datetime(2026, 5, 1, 12) + dt.timedelta(seconds=i / 10), float(v)) for i, v in enumerate(heave)], "k string, time timestamp, value double")
    found = {r["time"]: r["height"] for r in split.wave_heights(df, ["k"], "value", width=60, bucket="1 minute").collect()}
    y = stateful.high_passed(heave, 1 / (1 + 2 * np.pi * 0.05 / 10))
    want = {dt.datetime(2026, 5, 1, 12) + dt.timedelta(seconds=e): 4 * np.std(y[max(0, (e - 60) * 10) : e * 10], ddof=1) for e in range(5, 210, 5)}
    assert found.keys() == want.keys() and all(abs(found[t] - want[t]) < 1e-8 for t in want)


def spans(rows, on):
    """(since, ended) of runs of rows [(time, value)] where ``on`` holds."""
    out, since = [], None
    for t, v in sorted(rows):
        if on(v) and since is None:
            since = t
        if not on(v) and since is not None:
            out.append((since, t))
            since = None
    return [*out, (since, None)] if since is not None else out


@pytest.mark.parametrize("bucket", ["1 minute", "1 day"])
def test_stretches_and_their_intersection(series, bucket):
    asof = at(10_000_000)
    by = {}
    for r in series.collect():
        by.setdefault(r["k"], []).append((r["time"], r["value"]))
    tests = [lambda v: v is not None and v > -1, lambda v: v is not None and v < 2, lambda v: v is not None and abs(v) > 0.2]
    parts = [split.stretches(series, ["k"], c, bucket=bucket) for c in (F.col("value") > -1, F.col("value") < 2, F.abs("value") > 0.2)]
    assert rows_of(parts[0], "k", "since", "ended") == sorted(((k, *s) for k, rows in by.items() for s in spans(rows, tests[0])), key=repr)
    found = rows_of(split.together(parts, ["k"], F.lit(asof)), "k", "since", "ended")
    want = sorted(((k, s, e or asof) for k, rows in by.items() for s, e in spans(rows, lambda v: all(t(v) for t in tests))), key=repr)
    assert found == want


@pytest.mark.parametrize("strict", [True, False])
def test_moving_in_parts(spark, series, strict):
    """Named figures are those of the aggregates taken afresh, with nulls, rows of one time, and a value that is not a number."""
    value = F.when(F.col("i") % 7 == 0, F.lit(None)).when(F.col("i") == 40, F.lit(float("nan"))).otherwise(F.col("value"))
    df = series.withColumn("value", value)
    df = df.unionByName(df.filter("i % 5 = 0").withColumn("i", F.col("i") + 100_000))
    named = {"m": ("mean", "value"), "n": ("count", F.lit(1)), "some": ("count", "value"), "total": ("sum", "value"), "low": ("min", "value"), "high": ("max", "value")}
    fresh = {"m": F.avg("value"), "n": F.count(F.lit(1)), "some": F.count("value"), "total": F.sum("value"), "low": F.min("value"), "high": F.max("value")}
    plain = lambda found: sorted((r["i"], *(None if r[k] is None else round(r[k], 8) for k in named)) for r in found.collect())
    got, want = (split.moving(df, ["k"], v, "5 minutes", strict) for v in (named, fresh))
    assert got.columns == want.columns and repr(plain(got)) == repr(plain(want))
