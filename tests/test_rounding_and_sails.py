import datetime as dt
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from brightwake.functions import sails, units
from brightwake.plans import panels


@pytest.mark.parametrize("digits", [0, 1, 2, 3, 6])
def test_rounding_decides_on_the_double_itself(spark, digits):
    dice = random.Random(digits)
    step = 10.0**-digits
    values = [0.0, 0.5, 1.5, 2.5, 0.125, 0.375, 1.005, 2.675, 1.45, 8.345, -0.001, -2.5, -1.005, 123456.785, 0.1 + 0.2]
    values += [round(dice.randint(0, 10**6) * step + step / 2, digits + 1) for _ in range(600)] + [dice.uniform(-1e5, 1e5) for _ in range(300)] + [k / 64 for k in range(300)]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),), (1e300,)], "v double").select("v", units.to_fixed(F.col("v"), digits).alias("text"), units.round_even(F.col("v"), digits).alias("even")).collect()
    for r in rows:
        if r.v is None or r.v != r.v or r.v == 1e300:
            assert r.text is None and r.even is None
            continue
        up = Decimal(abs(r.v)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)
        assert r.text == ("-" if r.v < 0 else "") + f"{up:.{digits}f}", r.v
        assert r.even == round(r.v, digits), r.v
    with pytest.raises(ValueError):
        units.to_fixed(F.lit(1.0), 7)


def test_rounded_is_what_round_gives(spark):
    dice = random.Random(6)
    values = [0.0, -0.0, -1e-9, 4.9999999e-7, 5e-7, -5e-7, 1.0000005, 2.0000015, -0.1234565, 999.9999995, 1000.0000005, 123456789.1234565, 1e15 + 0.3, 1e300, float("inf"), float("-inf"), float("nan"), None]
    values += [dice.randint(-(10**9), 10**9) / 1e6 + 5e-7 for _ in range(3000)] + [dice.uniform(-1200, 1200) for _ in range(3000)]
    same = F.col("a").cast("string").eqNullSafe(F.col("b").cast("string"))  # as text, so that -0.0 is not 0.0
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", units.rounded(F.col("v"), 6).alias("a"), F.round("v", 6).alias("b"))
    assert rows.filter(~same).collect() == []


def test_units_as_metadata(spark):
    df = units.with_units(spark.createDataFrame([(1.0, 2.0, 3.0)], "boat_speed double, Heel double, other double"), {"speed": "knots", "heel": "degree"})
    assert [df.schema[c].metadata.get("unit") for c in df.columns] == ["knots", "degree", None] and df.collect() == [(1.0, 2.0, 3.0)]


def test_colours_and_labels(spark):
    steps = [(None, "green"), (10.0, "orange"), (20.0, "red")]
    rows = spark.createDataFrame([(None, None), (-5.0, "up"), (10.0, "down"), (25.0, "odd")], "v double, s string").select(panels.coloured(F.col("v"), steps).alias("c"), panels.mapped(F.col("s"), {"up": "Hoisted", "down": "Lowered"}).alias("m")).collect()
    assert [tuple(r) for r in rows] == [("green", None), ("green", "Hoisted"), ("orange", "Lowered"), ("red", "odd")]


def test_sails(spark):
    rows = [(14.0, 40.0, 21.0, "calm", 0.9), (14.0, -40.0, -25.0, "rough", 0.8), (5.0, 100.0, 5.0, "moderate", 0.7), (22.0, 170.0, 10.0, "rough", None), (None, 40.0, 1.0, "calm", 0.5), (9.0, 130.0, None, None, None)]
    found = sails.recommended(spark.createDataFrame(rows, "tws double, twa double, heel double, sea string, efficiency double")).select("main", "jib", "spinnaker", "heel_target", "heel_alert", "may_add_sail")
    assert [tuple(r) for r in found.collect()] == [
        ("1 reef", "working", "down", 18.0, "warning", False), ("2 reefs", "working", "down", 16.0, "critical", False), ("full", "genoa", "up", 16.0, None, True),
        ("down", "poled", "down", 12.0, None, False), (None, None, None, None, None, False), ("full", "working", "ready", 18.0, None, False),
    ]
    assert len({(p, w) for p, w, *_ in sails.SAIL_PLAN}) == 18


def test_spinnaker(spark):
    lit = [F.lit(x) for x in (9.0, 170.0, 12.0, 10.0, 5.0)]
    rows = spark.range(1).select(sails.may_hoist(*lit, F.lit(False)), sails.may_hoist(F.lit(12.0), *lit[1:], F.lit(False)), sails.may_hoist(F.lit(12.0), *lit[1:], F.lit(True)), sails.must_douse(lit[1], F.lit(19.0), lit[3], F.lit(False)), sails.must_douse(lit[1], lit[2], lit[3], F.lit(False))).first()
    assert tuple(rows) == (True, False, True, True, False)


def test_day_stamps(spark):
    row = spark.range(1).select(units.day_stamp(F.lit(dt.datetime(2026, 5, 1, 23, 59))), units.underscored(F.lit("Western Long Island"))).first()
    assert tuple(row) == ("20260501", "Western_Long_Island")
