import math

import pytest
from pyspark.sql import functions as F

from brightwake.functions import angles, classify, geo, nautical, units


@pytest.fixture(scope="module")
def one(spark):
    row = spark.range(1)

    def get(column):
        return row.select(column.alias("x")).first()[0]

    return get


def rad(d):
    return F.lit(math.radians(d))


@pytest.mark.parametrize(("sog", "cog", "stw", "hdg", "drift", "towards"), [(6.0, 320, 6.0, 320, 0.0, None), (6.5, 320, 6.0, 320, 0.5, 320.0), (6.4, 330, 6.0, 320, 1.152, 34.8), (5.5, 45.2, 5.2, 42.1, 0.417, 87.6)])
def test_current(one, sog, cog, stw, hdg, drift, towards):
    args = (F.lit(sog), rad(cog), F.lit(stw), rad(hdg))
    assert one(nautical.current_drift(*args)) == pytest.approx(drift, abs=5e-4)
    if towards is not None:
        assert math.degrees(one(nautical.current_set(*args))) == pytest.approx(towards, abs=0.05)


def test_worked_examples(one):
    assert one(nautical.calibrated(F.lit(5.0), 0.1, 0.98)) == pytest.approx(4.802)
    assert one(nautical.polynomial(F.lit(2.0), [1.0, 2.0, 3.0])) == 17.0
    assert one(angles.degrees_signed(F.lit(-0.005177))) == pytest.approx(-0.2966, abs=1e-4)
    assert one(angles.course(F.lit(2.209587))) == pytest.approx(126.6, abs=0.01)
    assert one(nautical.fatigue(F.lit(6.0), F.lit(6.5))) == pytest.approx(7.69, abs=0.01)
    assert one(nautical.rated_vmg(F.lit(4.0), F.lit(0))) is None
    assert one(units.fixed(F.lit(5.1443), 1)) == "5.1"


def test_angles(one):
    assert one(angles.difference(F.lit(10.0), F.lit(350.0))) == 20.0
    assert one(angles.difference(F.lit(0.0), F.lit(180.0))) == -180.0
    assert one(angles.compass(F.lit(11.25))) == "NNE"
    assert one(angles.compass(F.lit(-1.0))) == "N"
    assert one(angles.compass(F.lit(None).cast("double"), angles.POINTS_FR, "?")) == "?"
    assert one(angles.compass(F.lit(225.0), angles.POINTS_FR)) == "SO"
    assert one(angles.fold_180(F.lit(-350.0))) == 10.0


@pytest.mark.parametrize("turn", [0, 17.5, 90, 301])
def test_circular_mean_turns_with_its_values(spark, turn):
    df = spark.createDataFrame([(350.0,), (10.0,), (20.0,)], "d double")
    found = df.select(angles.circular_mean(F.col("d") + turn)).first()[0]
    assert (found - turn - 6.6) % 360 == pytest.approx(0.05, abs=0.1)


def test_geometry(one):
    a = (F.lit(41.0), F.lit(-73.0), F.lit(41.0), F.lit(-72.0))
    assert one(geo.distance(*a, geo.EARTH_KM)) == pytest.approx(83.9, abs=0.1)
    assert one(geo.bearing(*a)) == pytest.approx(89.67, abs=0.01)
    line = (F.lit(41.0), F.lit(-73.0), F.lit(41.0), F.lit(-72.9))
    assert one(geo.line_side(*line, F.lit(41.01), F.lit(-72.95))) == pytest.approx(1113.2, abs=0.1)
    assert one(geo.line_side(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(2.0), F.lit(2.0))) == 0.0


LADDERS = [
    (classify.efficiency_grade, [(80, "Poor"), (80.01, "Fair"), (90, "Fair"), (95, "Good"), (95.01, "Excellent")]),
    (classify.sail_plan, [(4.99, "Main + Jib1 (max area)"), (5, "Main + Jib1"), (20, "Storm jib only")]),
    (classify.start_status, [(301, "Preparing"), (300, "Countdown"), (0, "Starting"), (-30, "Started")]),
    (classify.line_status, [(499.9, "Very close to line"), (500, "Close to line"), (5000, "Very far from line")]),
    (classify.mode_from_true, [(-59.9, "upwind"), (60, "reach"), (150, "reach"), (150.1, "downwind")]),
    (classify.mode_from_apparent, [(59, "upwind"), (60, "reach"), (150, "reach"), (151, "downwind"), (210, "reach"), (301, "upwind"), (-30, "upwind")]),
    (classify.upwind_heel, [(11.9, "Underheeled"), (12, "Optimal"), (18, "Optimal"), (18.1, "Overheeled")]),
    (classify.moon_phase, [(0.0, "new_moon"), (0.0625, "waxing_crescent"), (0.5, "full_moon"), (0.9375, "new_moon")]),
    (classify.start_line_side, [(49.9, "on line"), (50, "before"), (-50, "behind")]),
    (classify.weather_code, [(0, "Clear"), (48, "Foggy"), (99, "Thunderstorm"), (7, "Unknown (7)")]),
    (classify.signal_sequence, [(601, "10+ minutes: Prepare"), (59.7, "59s to start (1 horn blast at 0)"), (-30, "Race started")]),
]


@pytest.mark.parametrize(("ladder", "value", "label"), [(f, v, x) for f, cases in LADDERS for v, x in cases])
def test_ladder(one, ladder, value, label):
    assert one(ladder(F.lit(value))) == label


def test_ladders_of_null(one):
    for ladder, _ in LADDERS[:4]:
        assert one(ladder(F.lit(None).cast("double"))) is None


def test_workload(one):
    assert one(classify.workload(F.lit(7.0))).asDict() | {"assessment": ""} == {"level": "light", "percentage": 20, "rotation_minutes": 90, "watches": 2, "priority_positions": [], "assessment": ""}
    assert one(classify.workload(F.lit(16.0)))["priority_positions"] == ["Helmsman", "Main Trimmer", "Jib Trimmer", "Bowman"]
    assert one(classify.workload(F.lit(None).cast("double")))["level"] == "moderate"


def test_timer(one):
    assert [one(nautical.synced_timer(F.lit(s))) for s in (90, 91, 30, 29, -10)] == [60, 120, 0, 0, 0]
    assert one(nautical.clock(F.lit(3725))) == "1:02:05"
    assert one(nautical.clock(F.lit(65))) == "1:05"


def test_no_current_keeps_the_direction_of_its_sign(spark):
    from brightwake.functions import nautical

    df = spark.createDataFrame([(0.0, 180.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0), (1.0, 90.0, 0.0, 0.0)], "sog double, cog double, stw double, hdg double")
    got = [r[0] for r in df.select(F.degrees(nautical.current_set(F.col("sog"), F.radians("cog"), F.col("stw"), F.radians("hdg")))).collect()]
    want = [math.degrees(math.atan2(s * math.sin(math.radians(c)) - w * math.sin(math.radians(h)), s * math.cos(math.radians(c)) - w * math.cos(math.radians(h)))) % 360 for s, c, w, h in df.collect()]
    assert got == pytest.approx(want) and want[0] == 180.0
