"""Streams with timers, replayed file by file, against plain loops and the batch forms."""

import datetime as dt
import random
from collections import defaultdict


import numpy as np
import pytest


from brightwake.streaming import stateful

T0 = dt.datetime(2026, 5, 1, 12)
POINTS = "k string, time timestamp, value double"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


class Replay:
    """Writes rows as files, one micro-batch each, and drains a stream over them; more files may follow and it goes on."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.n = spark, path, schema, 0
        (path / "in").mkdir(parents=True)

    def add(self, *batches):
        for rows in batches:
            name = self.path / f"part{self.n:05d}"
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(str(name))
            file = next(name.glob("*.parquet"))
            file.rename(self.path / "in" / f"{self.n:05d}.parquet")
            self.n += 1
        return self

    def drain(self, transform):
        out = []
        source = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(str(self.path / "in"))
        query = transform(source).writeStream.foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", str(self.path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None
        return out


@pytest.fixture
def replay(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield lambda schema=POINTS, name="r": Replay(spark, tmp_path / name, schema)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def states_by_force(rows, limit, hold, nodata, until):
    """Second by second: (state, second) transitions of integer-second rows [(second, value)]."""
    out, state, since, last = [], None, None, None
    by = defaultdict(list)
    for s, v in rows:
        by[s].append(v)
    for s in range(min(by), until + 1):
        if last is not None and state == "pending" and s - since >= hold and s - last <= nodata:
            out.append(("firing", s))
            state = "firing"
        if last is not None and state not in (None, "nodata") and s - last == nodata and not (s in by):
            out.append(("nodata", s))
            state = "nodata"
        for v in by.get(s, []):
            now = "error" if np.isnan(v) else "pending" if v > limit else "normal"
            if now != ("pending" if state == "firing" else state):
                out.append((now, s))
                state, since = now, s
            last = s
    return out


def test_alerts_fire_and_fall_silent_without_a_row(replay):
    found = replay().add([("a", at(0), 9.0)], [("b", at(3), 1.0)], [("c", at(400), 1.0)]).drain(lambda p: stateful.alert_states(p, ["k"], ">", 5.0, 30, 300, "1 second"))
    assert {(r["k"], r["state"], r["time"]) for r in found} == {("a", "pending", at(0)), ("a", "firing", at(30)), ("a", "nodata", at(300)), ("b", "normal", at(3)), ("b", "nodata", at(303))}


def test_alert_states_against_seconds(replay):
    rng = random.Random(4)
    rows, want = [], set()
    for k in "abc":
        s, own = rng.randrange(5), []
        for _ in range(120):
            own.append((s, rng.choice([1.0, 9.0, 9.0, 9.0, float("nan")] if rng.random() < 0.3 else [own[-1][1] if own else 9.0])))
            s += rng.choice([1, 1, 2, 3, 5, 25])
        rows += [(k, at(x), v) for x, v in own]
        want |= {(k, state, at(x)) for state, x in states_by_force(own, 5.0, 7, 20, 990)}
    rows = sorted((r for r in rows), key=lambda r: r[1].timestamp() + rng.uniform(0, 8))  # late by less than the delay
    batches = [rows[i : i + 40] for i in range(0, len(rows), 40)]
    found = replay().add(*batches, [("end", at(1000), 0.0)]).drain(lambda p: stateful.alert_states(p, ["k"], ">", 5.0, 7, 20, "10 seconds"))
    assert {(r["k"], r["state"], r["time"]) for r in found if r["time"] <= at(980) and r["k"] != "end"} == {w for w in want if w[2] <= at(980)}


def test_alert_states_go_on_after_a_restart(replay):
    run = replay().add([("a", at(0), 9.0)], [("a", at(20), 9.0)])
    transform = lambda p: stateful.alert_states(p, ["k"], ">", 5.0, 30, 300, "1 second")
    first = run.drain(transform)
    then = run.add([("z", at(100), 0.0)], [("a", at(110), 1.0)], [("z", at(200), 0.0)]).drain(transform)
    assert [(r["state"], r["time"]) for r in first] == [("pending", at(0))]
    assert [(r["state"], r["time"]) for r in then if r["k"] == "a"] == [("firing", at(30)), ("normal", at(110))]


ALERTS = "alertname string, instance string, severity string, category string, name string, active boolean, time timestamp"


def alert(seconds, active, name="x", severity="critical", category="system", alertname="heel"):
    return (alertname, "boat", severity, category, name, active, at(seconds))


def messages(found, alertname="heel"):
    return [(r["receiver"], (r["time"] - T0).total_seconds(), r["message"], r["n"]) for r in sorted(found, key=lambda r: r["time"]) if r["alertname"] == alertname]


def test_notification_groups_wait_gather_and_repeat(replay):
    """Critical: after 10 s, then at ticks of 60 s if changed, and every 300 s; the end is told once."""
    batches = [[alert(0, True)], [alert(4, True, "y")], [alert(30, True, "z")], [alert(100, False, "z")], [alert(800, False, "x"), alert(805, False, "y")], [alert(2000, True, alertname="end")]]
    found = replay(ALERTS).add(*batches).drain(lambda a: stateful.notifications(a, late="1 second"))
    assert messages(found) == [("Telegram", 10, "first", 2), ("Telegram", 70, "changed", 3), ("Telegram", 130, "changed", 2), ("Telegram", 430, "repeat", 2), ("Telegram", 730, "repeat", 2), ("Telegram", 850, "resolved", 0)]


def test_notification_policies(replay):
    rows = [alert(0, True, severity="warning", category=c, alertname=c) for c in ("racing", "weather", "other")] + [alert(0, True, severity="info", alertname="info")]
    found = replay(ALERTS).add(rows, [alert(4000, True, alertname="end")]).drain(lambda a: stateful.notifications(a, late="1 second"))
    times = lambda name: [t for _, t, _, _ in messages(found, name)]
    assert times("racing") == list(range(5, 4000, 30)) and times("weather") == list(range(60, 4000, 600)) and times("other") == [10] and times("info") == [300, 3900]
    assert {r["receiver"] for r in found if r["alertname"] == "info"} == {"Built-in"}


def test_what_ends_before_its_first_message_is_not_told(replay):
    found = replay(ALERTS).add([alert(0, True), alert(3, False)], [alert(500, True, alertname="end")]).drain(lambda a: stateful.notifications(a, late="1 second"))
    assert messages(found) == []


def test_history_against_each_window(replay):
    rng = random.Random(6)
    rows, s = [], 0.0
    for _ in range(1500):
        s += rng.choice([0, 0.5, 3, 10, 10, 300]) if rng.random() < 0.2 else 1.5
        rows.append((rng.choice("ab"), at(s), rng.uniform(-5, 5)))
    batches = [rows[i : i + 150] for i in range(0, len(rows), 150)]
    found = replay().add(*batches, [("end", at(s + 5000), 0.0)]).drain(lambda p: stateful.history(p, ["k"], 5))
    got = sorted((r["k"], r["time"], round(r["value"], 9)) for r in found if r["k"] != "end")
    # Arrivals at one time are taken one after the other, in the order of their arrival.
    want = []
    for k in "ab":
        own = [r for r in rows if r[0] == k]
        for i, (_, t, _) in enumerate(own):
            window = [v for _, u, v in own[: i + 1] if u > t - dt.timedelta(minutes=5)]
            want.append((k, t, round(sum(window) / len(window), 9)))
    assert got == sorted(want)


class _Dict:
    """Stands for a map or value state."""

    def __init__(self):
        self.d = {}

    def containsKey(self, k):
        return k in self.d

    def getValue(self, k):
        return self.d[k]

    def updateValue(self, k, v):
        self.d[k] = v

    def removeKey(self, k):
        del self.d[k]

    def clear(self):
        self.d.clear()

    def exists(self):
        return bool(self.d)

    def get(self):
        return self.d[0]

    def update(self, v):
        self.d[0] = v


def test_history_is_linear_in_arrivals():
    import time

    import pandas as pd

    def seconds(n):
        h = stateful.History(35 * 60)
        h.keys, h.state, h.minutes = ["k"], _Dict(), _Dict()
        us, began = np.arange(n) * 100_000, time.perf_counter()
        for i in range(0, n, 1000):
            part = us[i : i + 1000]
            h.advance(("a",), pd.DataFrame({"us": part, "value": np.ones(len(part))}), int(part[-1]))
        return time.perf_counter() - began

    seconds(5000)
    assert seconds(100_000) < 30 * max(seconds(10_000), 0.05)


def test_recent_alerts(replay):
    rows = [("q", at(i), f"alert {i}") for i in range(60)] + [("q", at(100), "alert 59"), ("q", at(700), "alert 59")]
    found = replay("k string, time timestamp, alert string").add(rows[:30], rows[30:], [("end", at(5000), "x")]).drain(lambda a: stateful.recent(a, ["k"]))
    own = sorted((r for r in found if r["k"] == "q"), key=lambda r: r["time"])
    assert len(own) == 61 and own[-1]["time"] == at(700) and own[-1]["alerts"] == [f"alert {i}" for i in range(51, 60)] + ["alert 59"]
    assert own[3]["alerts"] == [f"alert {i}" for i in range(4)]


def test_outbox_drops_the_oldest_and_gives_up(replay):
    rows = [("q", at(i * 0.1), f"m{i:02d}") for i in range(25)]
    found = replay("k string, time timestamp, text string").add(rows, [("end", at(1000), "x")]).drain(lambda m: stateful.outbox(m, ["k"], lambda texts: [not t.endswith("7") for t in texts]))
    own = [(r["outcome"], r["text"], r["failed"], (r["time"] - T0).total_seconds()) for r in found if r["k"] == "q"]
    assert {t for o, t, *_ in own if o == "dropped"} == {f"m{i:02d}" for i in range(5)}
    assert {(t, n, s) for o, t, n, s in own if o == "given up"} == {("m07", 3, 90.0), ("m17", 3, 90.0)}
    assert {t for o, t, *_ in own if o == "sent"} == {f"m{i:02d}" for i in range(5, 25) if i % 10 != 7} and len(own) == 25


def test_waves_against_sums(replay):
    rng = np.random.default_rng(5)
    n, rate = 3000, 10.0
    heave = np.sin(np.arange(n) / rate * 2 * np.pi / 7) + rng.normal(0, 0.1, n) + 3
    rows = [("a", at(i / rate), float(v)) for i, v in enumerate(heave)]
    found = replay().add(*(rows[i : i + 700] for i in range(0, n, 700)), [("end", at(2000), 0.0)]).drain(lambda p: stateful.waves(p, ["k"], width=60, step=5))
    rc, y = 1 / (2 * np.pi * 0.05), [0.0]
    keep = rc / (rc + 1 / rate)
    for a, b in zip(heave, heave[1:], strict=False):
        y.append(keep * (y[-1] + b - a))
    want = {at(end): 4 * np.std(y[max(0, (end - 60) * 10) : end * 10], ddof=1) for end in range(5, 360, 5) if len(y[max(0, (end - 60) * 10) : end * 10]) > 1}
    got = {r["time"]: r["height"] for r in found if r["k"] == "a"}
    assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-6 for t in want)
    assert 2.5 < got[at(200)] < 3.2  # four standard deviations of a sine of height one, most of which passes


def test_high_pass_is_the_same_in_pieces():
    values = np.random.default_rng(1).normal(size=500)
    whole = stateful.high_passed(values, 0.97)
    head = stateful.high_passed(values[:123], 0.97)
    tail = stateful.high_passed(values[123:], 0.97, values[122], head[-1])
    assert np.allclose(whole, np.concatenate([head, tail]), atol=1e-12) and whole[0] == 0
