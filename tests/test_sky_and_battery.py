"""Moon positions against a published example, moon times against a fine search, battery frames from their chunks."""

import datetime as dt
import math

from pyspark.sql import functions as F

from brightwake.functions import sky
from brightwake.sources import battery


def test_moon_against_the_published_example(spark):
    """Midnight of 12 April 1992: 133.1627 and -3.2291 degrees, 368,410 km, 0.679 of the disc lit."""
    t = F.lit("1992-04-12 00:00:00").cast("timestamp")
    longitude, latitude, distance = sky.moon_position(sky.days(t))
    r = spark.range(1).select(longitude, latitude, distance, sky.moon_illumination(t), sky.moon_phase(t)).first()
    assert abs(r[0] - 133.1627) < 0.1 and abs(r[1] + 3.2291) < 0.06 and abs(r[2] - 368_410) < 700 and abs(r[3] - 0.679) < 0.01 and 0.25 < r[4] < 0.5


def test_moon_times_against_minutes(spark):
    """Every crossing of a search by minutes is found, to the minute, at several latitudes; a day may lack a rise or a set."""
    days = [dt.datetime(2026, 5, 1) + dt.timedelta(days=k) for k in range(30)]
    places = [(41.06, -73.59), (0.0, 0.0), (-33.9, 151.2), (78.2, 15.6)]
    df = spark.createDataFrame([(d, la, lo) for d in days for la, lo in places], "day timestamp, lat double, lon double")
    found = df.select("day", "lat", sky.moonrise(F.col("day"), F.col("lat"), F.col("lon")).alias("rise"), sky.moonset(F.col("day"), F.col("lat"), F.col("lon")).alias("set")).collect()
    minutes = df.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(1440)))).select("day", "lat", "m", (sky._above(sky.days(F.col("day")) + F.col("m") / 1440, F.col("lat"), F.col("lon")) > 0).alias("up")).orderBy("day", "lat", "m").collect()
    by = {}
    for r in minutes:
        by.setdefault((r["day"], r["lat"]), []).append(r["up"])
    rises = 0
    for r in found:
        ups = by[r["day"], r["lat"]]
        for name, up in (("rise", True), ("set", False)):
            want = next((m for m in range(1440) if ups[m] != up and ups[m + 1] == up), None)
            if r[name] is None:
                assert want is None or abs(r["lat"]) > 70  # near the pole it may be up for less than an hour
            else:
                assert abs((r[name] - r["day"]).total_seconds() / 60 - want) <= 1.01
                rises += up
    assert rises > 90 and any(r["rise"] is None for r in found)
    # Rises come some 50 minutes later each day.
    own = [r["rise"] for r in sorted(found, key=lambda r: r["day"]) if r["lat"] == 41.06 and r["rise"]]
    gaps = [(b - a).total_seconds() / 3600 for a, b in zip(own, own[1:], strict=False)]
    assert all(24.2 < g < 25.5 for g in gaps)


def test_crc_of_a_known_command(spark):
    def plain(data):
        i = 0
        for b in data:
            i ^= b
            for _ in range(8):
                i = (i >> 1) ^ 140 if i & 1 else i >> 1
        return i

    data = [[], [0xEE, 0xC0, 0, 0, 0], list(range(256)), [255] * 20]
    found = spark.createDataFrame([(d,) for d in data], "d array<int>").select(battery.crc8(F.col("d"))).collect()
    assert [r[0] for r in found] == [plain(d) for d in data]


def framed(*body):
    crc = 0
    for b in body:
        crc = battery.crc_table()[crc ^ b]
    return bytes([*body, crc])


def test_frames_from_chunks(spark):
    t0 = dt.datetime(2026, 5, 1, 12)
    le = lambda v, n: list((v % (1 << 8 * n)).to_bytes(n, "little"))
    status = framed(0xCC, 0xF0, *le(13_120, 3), *le(-2_500_000, 3), *le(-33, 3), *le(-2_400_000, 3), *le(87, 2), *le(64, 2))
    name = framed(0xCC, 0xF1, *b"SK12V100")
    warm = framed(0xCC, 0xF2, 0, 0, 0, *le(-4, 2), *le(21, 2))
    maker = framed(0xCC, 0xF3, 24, *le(0x0512, 2), *(100 * 128).to_bytes(3, "big"), *le(1, 2), *le(1280, 2))
    cells = framed(0xCC, 0xF4, *(x for k, mv in enumerate((3250, 3245, 3240, 3255)) for x in (k + 1, *le(mv, 2), 0)))
    guard = framed(0xCC, 0xF5, 3, 1, 0)
    rows, s = [], 0
    for frame in (status, name, warm, maker, cells, guard):
        for k in range(0, len(frame), 7):
            rows.append(("a", t0 + dt.timedelta(seconds=s), k, frame[k : k + 7]))
        s += 1
    broken = bytearray(status)
    broken[4] ^= 1
    rows += [("a", t0 + dt.timedelta(seconds=100), 0, bytes(broken)), ("a", t0 + dt.timedelta(seconds=200), 0, status[:9]), ("a", t0 + dt.timedelta(seconds=210), 1, status[9:]), ("b", t0, 0, b"\x00\x01"), ("b", t0, 1, None), ("b", t0, 2, b""), ("b", t0, 3, guard)]
    df = spark.createDataFrame(rows, "device string, time timestamp, seq int, data binary").repartition(3)
    for bucket in ("1 minute", "1 day"):
        found = battery.readings(battery.frames(df, bucket=bucket)).orderBy("device", "time").collect()
        assert [(r["device"], r["kind"]) for r in found] == [("a", k) for k in ("status", "name", "temperature", "maker", "cells", "protection")] + [("b", "protection")]
        by = {r["kind"]: r for r in found if r["device"] == "a"}
        assert (by["status"]["voltage_v"], by["status"]["current_a"], by["status"]["power_w"], by["status"]["mean_current_a"], by["status"]["cycles"], by["status"]["soc_pct"]) == (13.12, -2.5, -33, -2.4, 87, 64)
        assert by["name"]["name"] == "SK12V100" and (by["temperature"]["temp_bms_c"], by["temperature"]["temp_mos_c"]) == (-4, 21)
        assert (by["maker"]["year_mfg"], by["maker"]["capacity_ah"], by["maker"]["heater"], by["maker"]["nominal_v"]) == (2024, 100.0, True, 12.8)
        assert [tuple(c) for c in by["cells"]["cells"]] == [(1, 3250), (2, 3245), (3, 3240), (4, 3255)] and math.isclose(by["cells"]["cells_v"], 12.99) and by["cells"]["cell_imbalance_mv"] == 15
        assert (by["protection"]["prot_flags"], by["protection"]["prot_cmos"], by["protection"]["prot_dmos"]) == (3, True, False)


def test_each_frame_is_read_once(spark):
    chunks = spark.createDataFrame([("b", dt.datetime(2026, 5, 1), 0, framed(0xCC, 0xF5, 3, 1, 0))], "device string, time timestamp, seq int, data binary")
    found = battery.readings(battery.frames(chunks))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("conv(") == plan.count("unhex(") == 1  # no filter works a frame out again
    assert [r["prot_flags"] for r in found.collect()] == [3]
