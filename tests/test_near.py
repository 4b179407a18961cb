import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from brightwake.operators import near
from brightwake.operators.components import components
from brightwake.plans import fleet

T0 = dt.datetime(2026, 5, 1)
PLACE = "step timestamp, vessel string, latitude double, longitude double, sog_kts double, cog_deg double, miles double"


def miles(a, b):
    p, q = math.radians(a[2]), math.radians(b[2])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
    return 2 * 3440.065 * math.asin(min(1.0, math.sqrt(h)))


def grouped(rows, radius):
    """Brute force: (step, vessel) to the least name of its group, and its size."""
    found = {}
    for step in {r[0] for r in rows}:
        own, seen = [r for r in rows if r[0] == step], set()
        for r in own:
            if r[1] in seen:
                continue
            group, todo = {r[1]: r}, [r]
            while todo:
                x = todo.pop()
                for y in own:
                    if y[1] not in group and miles(x, y) <= radius:
                        group[y[1]] = y
                        todo.append(y)
            seen |= set(group)
            found |= {(step, v): (min(group), len(group)) for v in group}
    return found


def scattered(centre, spread, n, seed, step=T0):
    dice = random.Random(seed)
    lat, lon = centre
    return [(step, f"{seed}-{i:03}", lat + dice.uniform(-spread, spread), (lon + dice.uniform(-spread, spread) / math.cos(math.radians(min(abs(lat), 89.9))) + 540) % 360 - 180, 6.0, 90.0, 1.0) for i in range(n)]


@pytest.mark.parametrize("centre", [(41.0, -73.0), (0.0, 180.0), (89.97, 10.0), (-60.0, -179.99)])
def test_pairs_and_clusters_like_brute_force(spark, centre):
    rows = scattered(centre, 0.04, 60, 1) + scattered(centre, 0.02, 30, 2, T0 + dt.timedelta(hours=1))
    places = spark.createDataFrame(rows, PLACE)
    want = {(a[0], *sorted((a[1], b[1]))) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and miles(a, b) <= 0.6}
    got = [(r.step, r.a.vessel, r.b.vessel) for r in near.pairs(places, 0.6, ["step"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {(r.step, r.vessel): (r.cluster, r.size) for r in near.clusters(places, 0.6, ["step"]).collect()} == grouped(rows, 0.6)


def test_a_crowd_in_one_cell_makes_no_pairs(spark):
    rows = [(T0, f"{i:05}", 41.0 + i % 7 * 1e-5, -73.0, 0.0, 0.0, 0.0) for i in range(20_000)] + [(T0, "z", 41.5, -73.0, 0.0, 0.0, 0.0)]
    found = near.clusters(spark.createDataFrame(rows, PLACE), 0.5, ["step"])
    assert {(r.cluster, r.size): r.n for r in found.groupBy("cluster", "size").agg(F.count("*").alias("n")).collect()} == {("00000", 20_000): 20_000, ("z", 1): 1}


def test_rows_that_lie_nowhere(spark):
    rows = [(T0, "a", 41.0, -73.0, None, 0.0, 1.0), (T0, "b", 41.001, -73.0, 3.0, None, 1.0), (T0, "c", None, -73.0, 1.0, 1.0, 1.0), (T0, None, 41.0, -73.0, 1.0, 1.0, 1.0), (None, "d", 41.0, -73.0, 1.0, 1.0, 1.0), (T0, "e", float("nan"), 0.0, 1.0, 1.0, 1.0)]
    places = spark.createDataFrame(rows, PLACE)
    met = {(r.vessel, r.other): (r.along_nm, r.closing_kts) for r in near.encounters(places, 0.5, ["step"]).collect()}
    assert set(met) == {("a", "b"), ("b", "a")} and met["a", "b"][0] == pytest.approx(0.06, abs=1e-3) and met["b", "a"] == (None, None) and met["a", "b"][1] is None
    assert {(r.vessel, r.cluster, r.size) for r in near.clusters(places, 0.5, ["step"]).collect()} == {("a", "a", 2), ("b", "a", 2)}
    none = places.filter("false")
    assert near.pairs(none, 0.5, ["step"]).count() == near.clusters(none, 0.5, ["step"]).count() == 0
    with pytest.raises(ValueError):
        near.pairs(places, 0.001, ["step"])


def test_passing_needs_closing_and_the_next_step(spark):
    def at(hour, vessel, north, knots, cog=0.0):
        return (T0 + dt.timedelta(hours=hour), vessel, 41 + north / 60, -73.0, float(knots), cog, 0.0)

    rows = [at(0, "a", 0, 5), at(1, "a", 0.2, 5), at(0, "fast", -0.3, 9), at(1, "fast", 0.4, 9), at(0, "late", -0.1, 9), at(2, "late", 0.4, 9), at(2, "a", 0.3, 5), at(0, "drift", -0.2, 2), at(1, "drift", 0.3, 2)]
    met = near.encounters(spark.createDataFrame(rows, PLACE), 0.8, ["step"])
    got = {(r.vessel, r.other): r for r in near.passings(met, "1 hour").collect()}
    assert ("a", "fast") in got and got["a", "fast"].astern_nm == pytest.approx(-0.3, abs=1e-3) and got["a", "fast"].closing_kts == pytest.approx(4, abs=1e-6)
    assert ("a", "late") not in got and ("a", "drift") not in got and ("fast", "a") not in got


def test_encounters_shuffle_few_copies_and_broadcast_none(spark):
    places = spark.createDataFrame(scattered((41.0, -73.0), 0.1, 400, 4), PLACE)
    found = near.encounters(places, 0.5, ["step"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    moved = found._jdf.queryExecution().optimizedPlan().toString()
    assert "__gap" in moved and "miles" in moved  # only cells that a place can reach get a copy of it
    assert found.count() == 2 * near.pairs(places, 0.5, ["step"]).count() > 0


def test_encounters_come_in_runs_of_equal_figures(spark):
    """Rows of a vessel, and equal figures of vessels on one spot, follow one another, so files of many encounters stay small."""
    spots = [(41.0, -73.0), (41.003, -73.0), (41.0, -73.004)]
    rows = [(T0, f"{k:03}", *spots[k % 3], 6.0, 90.0, 0.0) for k in range(150)]
    found = near.encounters(spark.createDataFrame(rows, PLACE).repartition(3), 0.5, ["step"]).collect()
    runs = lambda *names: sum(1 for a, b in zip([None, *found], found) if a is None or any(a[n] != b[n] for n in names))
    assert len(found) == 150 * 149 and runs("vessel") == 150 and runs("vessel", "miles", "along_nm", "closing_kts") <= 150 * 5


@pytest.mark.parametrize("together", [64, 2])
@pytest.mark.parametrize("centre", [(41.0, -73.0), (0.0, 180.0), (89.97, 10.0), (-60.0, -179.99)])
def test_encounters_like_brute_force(spark, monkeypatch, centre, together):
    monkeypatch.setattr(near, "TOGETHER", together)
    rows = scattered(centre, 0.06, 60, 1) + scattered(centre, 0.01, 30, 2, T0 + dt.timedelta(hours=1))
    rows += [(step, f"{v}'", lat, lon, None, 90.0, 1.0) for step, v, lat, lon, *_ in rows[:5]]
    found = near.encounters(spark.createDataFrame(rows, PLACE), 0.6, ["step"]).collect()
    want = {(a[0], a[1], b[1]): miles(a, b) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and miles(a, b) <= 0.6}
    assert len(found) == len(want) and {(r.step, r.vessel, r.other): r.miles for r in found} == pytest.approx(want, abs=1e-9)
    assert {r.closing_kts is None for r in found if r.vessel.endswith("'") or r.other.endswith("'")} == {True} and all(r.along_nm is not None and abs(r.along_nm) <= r.miles + 1e-12 for r in found)


def test_components_of_a_long_path_a_hub_and_repeats(spark):
    path = [(i, i + 1) for i in range(700)]
    random.Random(3).shuffle(path)
    edges = path + path[:50] + [(5000, 1000 + i) for i in range(500)] + [(7, 7), (9000, None), (None, 1)] + [(2001, 2000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(701)} | {1000 + i: 1000 for i in range(500)} | {5000: 1000, 2000: 2000, 2001: 2000}
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_short_rests(spark):
    hour = lambda h: T0 + dt.timedelta(hours=h)
    rows = [(1, hour(0), "ann"), (1, hour(1), "ann"), (1, hour(2), "bo"), (1, hour(3), "ann"), (1, hour(5), "cy"), (1, hour(7), "ann"), (1, None, "bo"), (1, hour(8), None), (2, hour(0), "ann"), (2, hour(1), "bo")]
    found = fleet.short_rests(spark.createDataFrame(rows, "boat int, time timestamp, helmsman string"), ["boat"])
    assert {(r.boat, r.time, r.helmsman, r.rest_seconds) for r in found.collect()} == {(1, hour(3), "ann", 3600.0)}


def test_speed_drops(spark):
    at = lambda h, v: (1, T0 + dt.timedelta(hours=h), v)
    rows = [at(0, 10.0), at(0.5, 10.0), at(1, 8.4), at(2, 8.3), at(4, 1.0), at(5, 0.0), at(6, 5.0), at(7, None)]
    found = fleet.speed_drops(spark.createDataFrame(rows, "boat int, time timestamp, value double"), ["boat"])
    assert [(r.since, round(r.loss_pct, 6)) for r in found.orderBy("since").collect()] == [(T0 + dt.timedelta(hours=1), 16.0), (T0 + dt.timedelta(hours=5), 100.0)]


def test_overtaken_is_what_passings_finds(spark):
    rng = random.Random(5)
    rows = [(at, f"v{k}", 40 + rng.random() / 40, -73 + rng.random() / 40, rng.random() * 12, rng.random() * 360) for k in range(60) for at in (dt.datetime(2024, 1, 1) + dt.timedelta(hours=h) for h in range(6)) if rng.random() < 0.8]
    places = spark.createDataFrame(rows, "step timestamp, vessel string, latitude double, longitude double, sog_kts double, cog_deg double")
    plain = lambda found: sorted((r.step, r.vessel, r.other, round(r.astern_nm, 9), round(r.along_nm, 9), round(r.closing_kts, 9)) for r in found.collect())
    got = plain(near.overtaken(places, 0.5, "1 hour"))
    assert got and got == plain(near.passings(near.encounters(places, 0.5, ["step"]), "1 hour"))
    ahead, here = near.sent_ahead(places, 0.5, ["step"])
    assert ahead.count() < 10 * here.count()  # of 14 cells ahead


@pytest.mark.parametrize("few", [64, 0])
def test_crowds_are_joined_without_all_their_pairs(spark, monkeypatch, few):
    """Two crowds a hair beyond the radius, then two of which only one place of each is near the other; the same when all parts are halved to the end."""
    monkeypatch.setattr(near, "FEW", few)
    rows = []
    for hour, gap in ((0, 0.5003), (1, 0.4999)):
        step, dice = T0 + dt.timedelta(hours=hour), random.Random(hour)
        for name, sign in (("w", -1), ("e", 1)):
            rows += [(step, f"{name}{i:03}", 41 + dice.uniform(-1, 1) * 0.0008, -73 + sign * (0.26 + dice.random() * 0.1) / 60 / math.cos(math.radians(41)), 0.0, 0.0, 0.0) for i in range(120)]
            rows.append((step, f"{name}tip", 41.0, -73 + sign * gap / 2 * 60 / 3440.065 / 60 * 180 / math.pi / math.cos(math.radians(41)), 0.0, 0.0, 0.0))
        rows += scattered((41.05, -73.0), 0.03, 40, 7, step)
    places = spark.createDataFrame(rows, PLACE)
    got = {(r.step, r.vessel): (r.cluster, r.size) for r in near.clusters(places, 0.5, ["step"]).collect()}
    assert got == grouped(rows, 0.5) and got[T0, "wtip"] != got[T0, "etip"] and got[T0 + dt.timedelta(hours=1), "wtip"] == got[T0 + dt.timedelta(hours=1), "etip"]


def test_crowds_of_different_places_take_no_time_of_pairs(spark):
    """Four times 30,000 places, no two on one spot: a step whose crowds are linked, and one where each place is a little too far from all of the other crowd."""
    import time

    degree = 180 / math.pi / 3440.065
    east = F.col("id") % 2 * 2 - 1
    gap = F.when(F.col("id") % 4 < 2, 0.4).otherwise(0.53)
    rows = spark.range(120_000).select(
        F.when(F.col("id") % 4 < 2, F.lit(T0)).otherwise(F.lit(T0 + dt.timedelta(hours=1))).alias("step"), F.format_string("%06d", "id").alias("vessel"), (F.rand(1) * 0.02 * degree).alias("latitude"), (east * (gap / 2 + F.rand(2) * 0.02 - 0.01) * degree).alias("longitude")
    )
    began = time.perf_counter()
    found = near.clusters(rows, 0.5, ["step"]).groupBy("step", "cluster", "size").count().collect()
    assert time.perf_counter() - began < 60
    assert sorted((r.step, r.cluster, r.size, r["count"]) for r in found) == [(T0, "000000", 60_000, 60_000), *((T0 + dt.timedelta(hours=1), v, 30_000, 30_000) for v in ("000002", "000003"))]
