"""Weather and buoy tools on points with and without places, and with one side missing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from brightwake.plans import tools
from brightwake.sources import points

T0 = dt.datetime(2026, 5, 1, 12)


def asof():
    return F.lit(T0).cast("timestamp")


def point(minutes, measurement, value, text=None, **tags):
    return (T0 - dt.timedelta(minutes=minutes), measurement, "value", value, text, None, None, tags)


@pytest.fixture
def made(spark):
    return lambda *rows: spark.createDataFrame(list(rows), points.POINT)


def test_only_the_place_itself_counts(made):
    rows = made(point(20, "weather.wind_speed", 50.0, location="stamford"), point(5, "weather.wind_speed", 20.0), point(4, "weather.wind_speed", 30.0, location="newport"), point(6, "weather.temperature", 20.0, location="stamford"))
    w = tools.get_current_weather(rows, asof()).first()
    assert w["wind_speed_kmh"] == 50.0 and w["wind_speed_knots"] == 27.0 and w["temperature_celsius"] == 20.0 and w["condition"] == "Unknown"
    a = tools.get_wind_assessment(rows, asof()).first()
    assert (a["wind_speed_knots"], a["wind_gust_knots"], a["wind_range"]) == (27.0, None, "27.0 - 27.0 knots")


def test_no_wind_no_assessment(made):
    assert tools.get_wind_assessment(made(point(5, "weather.temperature", 20.0, location="stamford"), point(5, "weather.wind_speed", 20.0)), asof()).count() == 0


@pytest.mark.parametrize("now, before, want", [
    (21.0, 20.0, ("Warming", 1.0, "Temperature warming (+1.0°C last 30 min)")), (19.0, 20.0, ("Cooling", -1.0, "Temperature cooling (-1.0°C last 30 min)")), (20.0, 20.0, ("Stable", 0.0, "Temperature stable (0.0°C last 30 min)")),
    (20.3, 20.0, ("Stable", 0.3, "Temperature stable (+0.3°C last 30 min)")), (21.0, None, ("Stable", 0.0, "Temperature stable (0.0°C last 30 min)")), (None, 21.0, ("Stable", 0.0, "Temperature stable (0.0°C last 30 min)")), (None, None, ("Stable", 0.0, "Temperature stable (0.0°C last 30 min)")),
])
def test_weather_trend(made, now, before, want):
    rows = [point(m, "weather.temperature", v, location="stamford") for m, v in ((5, now), (45, before)) if v is not None]
    assert tuple(tools.get_weather_trend(made(*rows, point(1, "weather.temperature", 99.0)), asof()).first()) == want


def test_buoys_from_canonical_points(spark, made, tmp_path):
    rows = made(point(30, "buoy.wind_speed_knots", 12.0, station="44065"), point(10, "buoy.wind_speed_knots", 14.0, station="44065"), point(9, "buoy.wind_gust_knots", 18.0, station="44065"), point(10, "buoy.wind_speed_knots", 9.0, station="44099"), point(10, "buoy.wave_height", 1.2), point(10, "weather.wind_speed", 1.0))
    points.write(rows, str(tmp_path / "points"))
    back = points.read(spark, str(tmp_path / "points"))
    found = {r["station"]: r for r in tools.get_buoy_data(back, asof()).collect()}
    assert found.keys() == {"44065", "44099", "unknown"}
    assert (found["44065"]["wind_speed"], found["44065"]["location"], found["44065"]["distance"]) == (14.0, "41.063°N, -73.591°W", "5 nm")
    assert (found["44099"]["name"], found["44099"]["location"], found["unknown"]["wave_height"]) == ("Unknown", "0°N, 0°W", 1.2)
    c = tools.get_wind_comparison(back, asof()).first()
    assert c["summary"] == ["44065 Stamford (Western LIS): 14.0 kts, gust 18.0 kts, 5 nm", "44099 Unknown: 9.0 kts, ?"] and (c["strongest"], c["weakest"], c["average_wind"]) == ("Stamford (Western LIS)", "Unknown", 11.5)


def test_the_weather_query_reads_every_users_points(spark, tmp_path):
    from brightwake.plans import tool_queries

    m = [name for name, _, _ in points.BOAT].index("weather.temperature")
    rows = [(m, dt.datetime(2024, 1, 1), 1, "view", 200.0, "{}"), (m + len(points.BOAT), dt.datetime(2024, 1, 2), 2, "view", 250.0, "{}"), (m + 2 * len(points.BOAT), dt.datetime(2024, 1, 3), 0, "view", 300.0, "{}")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    (r,) = tool_queries.QUERIES["get_current_weather"](spark, str(tmp_path)).collect()
    assert r["temperature_celsius"] == 15.0  # of user 2; the latest event itself ends the range
    assert "user_id % 3" not in tool_queries.ORACLES["get_current_weather"]
