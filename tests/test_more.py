import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from brightwake.functions import classify, documents, sky
from brightwake.operators import queues
from brightwake.plans import fleet, panels
from brightwake.sources import feeds
from brightwake.sources import points as P

T0 = dt.datetime(2026, 5, 1, 12)


@pytest.fixture(scope="module")
def one(spark):
    return lambda c: spark.range(1).select(c.alias("x")).first()[0]


def test_sun_and_moon(one):
    t = F.lit("2024-06-20 16:00:00").cast("timestamp")
    rise, down = one(sky.sunrise(t, F.lit(41.0), F.lit(-73.6))), one(sky.sunset(t, F.lit(41.0), F.lit(-73.6)))
    assert abs((rise - dt.datetime(2024, 6, 20, 9, 22)).total_seconds()) < 400 and abs((down - dt.datetime(2024, 6, 21, 0, 30)).total_seconds()) < 400
    assert one(sky.sunrise(t, F.lit(80.0), F.lit(0.0))) is None
    assert one(sky.moon_illumination(F.lit("2024-06-22 01:08:00").cast("timestamp"))) > 0.97
    assert one(sky.moon_phase(F.lit("2024-06-06 12:38:00").cast("timestamp"))) % 1 == pytest.approx(0, abs=0.03) or one(sky.moon_phase(F.lit("2024-06-06 12:38:00").cast("timestamp"))) > 0.97


def test_documents(one):
    x = F.lit('{"a":{"b":1,"c":[1,2]},"d":"x"}')
    assert one(documents.with_key(x, ["a", "z", "q"], F.lit('{"k":[1]}'))) == '{"d":"x","a":{"b":1,"c":[1,2],"z":{"q":{"k":[1]}}}}'
    assert one(documents.without_key(x, ["a", "b"])) == '{"d":"x","a":{"c":[1,2]}}'
    assert one(documents.without_key(F.lit("[1]"), ["a"])) is None
    assert json.loads(one(documents.merged(x, F.lit('{"a":{"b":2},"g":true}')))) == {"d": "x", "a": {"c": [1, 2], "b": 2}, "g": True}
    assert one(documents.count(x, "a.c")) == 2 and one(documents.count(x, "")) == 2 and one(documents.keys(x)) == ["a", "d"]


def test_states(one):
    assert one(classify.sea_state(F.lit(21), F.lit(26), F.lit(0))) == "rough" and one(classify.sea_state(F.lit(20), F.lit(25), F.lit(1.6))) == "calm"
    assert one(classify.sea_state_graded(F.lit(12), F.lit(10), F.lit(0.7))) == "moderate"
    assert [one(classify.limit_state(F.lit(k), F.lit(float(v)))) for k, v in (("roll", -41), ("house_voltage", 11.8), ("tws", 30), ("sonar", 1))] == ["critical", "warn", "ok", None]
    assert [one(classify.ring(F.lit(x))) for x in (0.1, 0.2, 0.99, 1.0)] == ["0.2 nm", "0.5 nm", "1 nm", None]


def test_race_events_and_metrics(spark):
    rows = spark.createDataFrame([(T0, "/api/sail", '{"sail":"Jib 2","type":"jib","change":1}'), (T0, "/api/start_line", '{"lat":41.0,"lon":-73.5,"point":"pin"}'), (T0, "/api/other", "{}"), (T0, "/api/timer", '{"active":true}')], "time timestamp, path string, body string")
    found = {(r["measurement"], r["field"]): r for r in feeds.race_events(rows).collect()}
    assert found["regatta.sails", "sail"]["value_string"] == "Jib 2" and found["regatta.sails", "change"]["value_double"] == 1.0 and found["regatta.sails", "sail"]["tags"] == {"type": "jib"}
    assert found["regatta.start_line", "lat"]["tags"] == {"point": "pin"} and found["regatta.timer", "active"]["value_boolean"] is True and len(found) == 5
    wide = spark.createDataFrame([(T0, 55.0, None)], "time timestamp, cpu double, ram double")
    assert [(r["field"], r["value_double"]) for r in feeds.long_form(wide, "system", ["cpu", "ram"]).collect()] == [("cpu", 55.0)]


def test_queues(spark):
    m = spark.createDataFrame([(i, T0 + dt.timedelta(seconds=i), i % 4, f"m{i}") for i in range(30)], "id int, time timestamp, retry_count int, message string")
    assert sorted(r["id"] for r in queues.kept(m, 20).collect()) == list(range(10, 30))
    assert queues.sendable(m).filter("retry_count = 3").count() == 0
    assert {r["retry_count"] for r in queues.drained(m, F.col("id") < 5).collect()} == {1, 2}
    sent = m.filter("id = 29").select(F.sha2("message", 256).alias("key"))
    assert sorted(r["id"] for r in queues.fresh(m, sent, F.lit(T0 + dt.timedelta(seconds=30)), 3).collect()) == [28]


def test_fleet(spark):
    targets = spark.createDataFrame([("a", 41.05, -73.0, 6.0, 10.0), ("b", 41.02, -73.01, 5.0, 350.0), ("far", 45.0, -73.0, 5.0, 0.0)], "mmsi string, latitude double, longitude double, sog_kts double, cog_deg double")
    own = spark.createDataFrame([(41.0, -73.0, 5.0)], "latitude double, longitude double, vmg double")
    found = fleet.around(targets, own, F.lit(0.0)).collect()
    assert [r["mmsi"] for r in found] == ["b", "a"] and found[0]["side"] == "left" and found[1]["class"] == "faster"
    standings = spark.createDataFrame([(1, "a", 5.0), (1, "b", 4.0), (2, "a", 5.0), (2, "b", 6.0)], "time int, boat string, score double")
    assert {(r["boat"], r["gained"]) for r in fleet.ranking_changes(standings).collect()} == {("a", -1), ("b", 1)}
    speeds = spark.createDataFrame([("a", T0 + dt.timedelta(minutes=i), 6.5 if i < 30 else 5.0) for i in range(60)], "boat string, time timestamp, value double")
    assert [r["grade"] for r in fleet.fatigue_index(speeds, ["boat"]).orderBy("time").collect()] == ["fresh", "tired"]


def test_every_panel_runs(spark):
    empty = spark.createDataFrame([], P.POINT)
    for spec in panels.PANELS:
        assert panels.panel(empty, spec, F.lit(T0)).count() == 0, spec.name
    assert len({p.name for p in panels.PANELS}) == len(panels.PANELS)
    rows = spark.createDataFrame([(T0, "regatta.sails", "mainsail_config", 2.0, None, None, None, {}), (T0, "weather.station", "wind_speed_kts", 9.0, None, None, None, {"station_name": "x", "zone": "CT", "type": "ndbc"})], P.POINT)
    now = F.lit(T0 + dt.timedelta(minutes=1))
    assert {r["panel"] for r in panels.latest_panels(rows, now).collect()} == {"sails_mainsail_config", "sails_now"}
    by = {p.name: p for p in panels.PANELS}
    assert panels.panel(rows, by["stations_latest"], now).first()["wind_speed_kts"] == 9.0 and panels.panel(rows, by["wind_mean_ct"], now).first()["value_double"] == 9.0
