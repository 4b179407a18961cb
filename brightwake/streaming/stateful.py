"""Stateful operators with event-time timers: held alerts, notification groups, bounded histories, queues, waves.

All keep what arrives until the watermark has passed it, and then take it in the order of event time, so that late rows
within the watermark's delay change nothing, and a bounded replay gives what the batch form gives. A timer wakes a key
when its next row, or its next deadline, is due: alerts fire and groups repeat without a further row. Work for a
micro-batch is on whole arrays; state holds what the window or the queue bounds, and goes when nothing more is due.

The state lives in RocksDB; ``prepare`` sets that for a session that has not chosen. A query that is started again on its
checkpoint folder goes on from there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> None:
    spark.conf.set(PROVIDER, ROCKS)


def micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy("datetime64[us]").astype(np.int64)


def stamps(us: list[int] | np.ndarray) -> pd.Series:
    return pd.Series(np.asarray(us, np.int64).astype("datetime64[us]"))


class InOrder(StatefulProcessor):
    """Hands each key's rows to ``advance`` in event-time order, once the watermark has passed them.

    ``columns`` are the columns beside ``time`` that are kept, with their types. ``advance`` gets the key, the rows up to the
    watermark (at least none) and the watermark, and gives the rows to put out and the time, in microseconds, at
    which it wants to be called next though no row comes (or nothing). Rows behind the watermark are dropped.
    """

    columns: dict[str, str] = {"value": "double"}  # noqa: RUF012
    own_state: str = "a long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(["us long", *(f"{c} {t}" for c, t in self.columns.items())]))
        self.due = handle.getValueState("due", "ms long, wanted long, seen long")
        self.state = handle.getValueState("own", self.own_state)

    def _wake(self, now: tuple, next_us: int | None, wanted: int | None, seen: int) -> None:
        """One timer at most: for the earliest of the waiting rows and of what ``advance`` wants."""
        times = [t for t in (next_us, wanted) if t is not None]
        ms = -(-min(times) // 1000) if times else None
        if now[0] is not None and now[0] != ms:
            self.handle.deleteTimer(now[0])
        if ms is not None and now[0] != ms:
            self.handle.registerTimer(ms)
        self.due.update((ms if ms is not None else -1, wanted if wanted is not None else -1, seen))

    def _due(self) -> tuple[int | None, int | None, int]:
        if not self.due.exists():
            return None, None, np.iinfo(np.int64).min
        ms, wanted, seen = self.due.get()
        return (None if ms < 0 else ms), (None if wanted < 0 else wanted), seen

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        due = self._due()
        pdf = pdf[pdf["time"].notna()]
        us = micros(pdf["time"])
        new = us > due[2]
        if new.any():
            us = us[new]
            kept = [[None if pd.isna(x) and kind != "double" else x for x in pdf[c][new]] for c, kind in self.columns.items()]
            self.waiting.appendList([(int(t), *own) for t, *own in zip(us, *kept, strict=True)])
            first = int(us.min())
            self._wake(due, first if due[0] is None else min(first, due[0] * 1000), due[1], due[2])
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        rows = pd.DataFrame(list(self.waiting.get()) if self.waiting.exists() else [], columns=["us", *self.columns])
        ready = rows["us"] <= until
        later = rows[~ready]
        if ready.any():
            if len(later):
                self.waiting.put([tuple(r) for r in later.itertuples(index=False)])
            else:
                self.waiting.clear()
        out, wanted = self.advance(key, rows[ready].sort_values("us", kind="stable").reset_index(drop=True), until)
        self._wake((None, None, 0), int(later["us"].min()) if len(later) else None, wanted, until)
        if out is not None and len(out):
            yield out

    def advance(self, key: tuple, rows: pd.DataFrame, until: int) -> tuple[pd.DataFrame | None, int | None]:
        raise NotImplementedError

    def get(self, default: tuple) -> tuple:
        return tuple(self.state.get()) if self.state.exists() else default


def applied(rows: DataFrame, keys: list[str], processor: InOrder, schema: str, late: str) -> DataFrame:
    """The processor over each key; ``schema`` is of the columns after the keys'."""
    prepare(rows.sparkSession)
    kinds = [f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys]
    picked = rows.select(*keys, "time", *(F.col(c).cast(t).alias(c) for c, t in processor.columns.items() if c not in keys)).withWatermark("time", late)
    return picked.groupBy(*keys).transformWithStateInPandas(processor, ", ".join([*kinds, schema]), "Append", "EventTime")


# ---- held alerts

NORMAL, BREACH, ERROR = 0, 1, 2
TESTS: dict[str, Callable[[np.ndarray, float], np.ndarray]] = {"<": np.less, "<=": np.less_equal, ">": np.greater, ">=": np.greater_equal}


class AlertStates(InOrder):
    """Transitions of one rule for each series: normal, pending, firing, nodata, error, each once when it begins.

    A breach is pending from its first row and fires when it has lasted for the hold, whether or not rows come meanwhile. Silence for
    ``nodata`` seconds ends any state. A value that is not a number is an error (of an evaluation); a missing value is no row.
    """

    own_state = "kind int, since long, fired boolean, last long"

    def __init__(self, test: str, limit: float, hold: float, nodata: float) -> None:
        self.test, self.limit, self.hold, self.nodata = test, limit, int(hold * 1e6), int(nodata * 1e6)

    def advance(self, key: tuple, rows: pd.DataFrame, until: int) -> tuple[pd.DataFrame | None, int | None]:
        kind, since, fired, last = self.get((-1, 0, False, 0))  # -1: silence
        us, values = rows["us"].to_numpy(np.int64), rows["value"].to_numpy(float)
        found = np.where(np.isnan(values), ERROR, np.where(TESTS[self.test](values, self.limit), BREACH, NORMAL))
        before = np.concatenate([[kind], found[:-1]])
        gaps = np.diff(us, prepend=last)
        turns = np.flatnonzero((found != before) | (gaps > self.nodata)) if len(us) else np.zeros(0, np.int64)
        out: list[tuple[str, int]] = []

        def until_then(end: int, last: int) -> None:
            """What falls due up to the next turn at ``end``, after the stretch's last row."""
            nonlocal kind, fired
            silence = last + self.nodata
            if kind == BREACH and not fired and since + self.hold <= min(end, silence):
                fired = True
                out.append(("firing", since + self.hold))
            if kind >= 0 and silence < end:
                kind = -1
                out.append(("nodata", silence))

        for i in turns:  # a stretch at a time, not a row
            until_then(int(us[i]), int(us[i - 1]) if i else last)
            kind, since, fired = int(found[i]), int(us[i]), False
            out.append((("normal", "pending", "error")[kind], since))
        last = int(us[-1]) if len(us) else last
        until_then(until + 1, last)
        waits = [t for t, on in ((since + self.hold, kind == BREACH and not fired), (last + self.nodata, kind >= 0)) if on]
        if kind < 0:
            self.state.clear()
        else:
            self.state.update((kind, since, fired, last))
        return _table(key, self.keys, {"state": [s for s, _ in out], "time": stamps([t for _, t in out])}), min(waits) + 1000 if waits else None


def _table(key: tuple, names: list[str], columns: dict[str, object]) -> pd.DataFrame:
    n = len(next(iter(columns.values())))
    return pd.DataFrame({k: pd.Series([v] * n) for k, v in zip(names, key, strict=True)} | columns)


def alert_states(points: DataFrame, keys: list[str], test: str, limit: float, hold: float, nodata: float, late: str = "10 seconds") -> DataFrame:
    """(keys, state, time) as the states begin. Rows without a value count as no rows."""
    processor = AlertStates(test, limit, hold, nodata)
    processor.keys = keys
    return applied(points.filter("value is not null"), keys, processor, "state string, time timestamp", late)


# ---- notification groups

@dataclass(frozen=True)
class Policy:
    """Times in seconds: before the first message of a group, between changes, and between repeats."""

    receiver: str
    column: str
    value: str
    wait: float
    interval: float
    repeat: float


# The first policy whose column has its value counts; the last takes all.
POLICIES = [
    Policy("Telegram", "severity", "critical", 10, 60, 300),
    Policy("Telegram", "category", "racing", 5, 30, 30),
    Policy("Telegram", "category", "weather", 60, 300, 600),
    Policy("Built-in", "severity", "info", 300, 900, 3600),
    Policy("Telegram", "", "", 10, 1800, 14400),
]


class Groups(InOrder):
    """A group's messages: the first after the wait, then at each interval if its alerts have changed, or the repeat is over.

    ``name`` tells the alerts of a group apart; ``active`` says whether one has begun or ended. A group whose alerts have all ended
    says so once, and is forgotten.
    """

    columns = {"name": "string", "active": "boolean", "category": "string"}  # noqa: RUF012
    own_state = "policy int, tick long, sent long, changed boolean, names array<string>"

    def __init__(self, policies: list[Policy]) -> None:
        self.policies = policies

    def _policy(self, key: tuple, category: str | None) -> int:
        known = dict(zip(self.keys, key, strict=True)) | {"category": category}
        return next(k for k, p in enumerate(self.policies) if not p.column or known.get(p.column) == p.value)

    def advance(self, key: tuple, rows: pd.DataFrame, until: int) -> tuple[pd.DataFrame | None, int | None]:
        policy, tick, sent, changed, names = self.get((-1, -1, -1, False, []))
        active, out = set(names), []

        def due() -> int | None:
            """When the group speaks next: its next tick if it has changed, else the first tick after the repeat."""
            if policy < 0:
                return None
            own = self.policies[policy]
            if changed or sent < 0:
                return tick
            step = int(own.interval * 1e6)
            return tick + max(0, -(-(sent + int(own.repeat * 1e6) - tick) // step)) * step

        def speak(before: int) -> None:
            nonlocal policy, tick, sent, changed
            while (at := due()) is not None and at < before:
                own = self.policies[policy]
                if active or sent >= 0:  # what ended before its first message needs none
                    out.append((own.receiver, at, "resolved" if not active else "first" if sent < 0 else "changed" if changed else "repeat", len(active)))
                tick, sent, changed = at + int(own.interval * 1e6), at, False
                if not active:
                    policy = -1

        for us, name, on, category in rows.itertuples(index=False):
            speak(us)
            if policy >= 0 and tick < us:  # ticks that had nothing to say
                step = int(self.policies[policy].interval * 1e6)
                tick += -(-(us - tick) // step) * step
            if on and policy < 0:
                policy = self._policy(key, category)
                tick, sent, changed = us + int(self.policies[policy].wait * 1e6), -1, True
            if policy >= 0 and (name in active) != bool(on):
                changed = True
                active.symmetric_difference_update([name])
        speak(until + 1)
        if policy < 0:
            self.state.clear()
        else:
            self.state.update((policy, tick, sent, changed, sorted(active)))
        columns = {"receiver": [r for r, *_ in out], "time": stamps([t for _, t, *_ in out]), "message": [m for *_, m, _ in out], "n": [n for *_, n in out]}
        return _table(key, self.keys, columns), due()


def notifications(alerts: DataFrame, keys: list[str] | None = None, policies: list[Policy] = POLICIES, late: str = "5 seconds") -> DataFrame:
    """(keys, receiver, time, message, n): what is sent for each group of alerts (``name``, ``active``, ``category``)."""
    processor = Groups(policies)
    processor.keys = keys = keys or ["alertname", "instance", "severity"]
    return applied(alerts, keys, processor, "receiver string, time timestamp, message string, n int", late)


# ---- histories of a bounded time

class History(InOrder):
    """For each arrival the mean over the last ``span`` seconds, its own included, the cut-off itself not.

    Rows lie in the state by minute. A running sum and count go with them: an arrival is added once and, when its minute falls out,
    read and subtracted once, so that work grows with the arrivals whatever the window holds. When no row has come for the window the state goes.
    """

    own_state = "total double, n long, first long, last long"

    def __init__(self, span: float) -> None:
        self.span = int(span * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.minutes = handle.getMapState("minutes", "minute long", "us array<long>, value array<double>")

    def _minute(self, minute: int) -> tuple[np.ndarray, np.ndarray]:
        if not self.minutes.containsKey((minute,)):
            return np.zeros(0, np.int64), np.zeros(0)
        us, value = self.minutes.getValue((minute,))
        return np.array(us, np.int64), np.array(value, float)

    def advance(self, key: tuple, rows: pd.DataFrame, until: int) -> tuple[pd.DataFrame | None, int | None]:
        total, n, first, last = self.get((0.0, 0, -1, -1))  # all rows before ``first`` have been subtracted
        rows = rows.dropna()
        us, values = rows["us"].to_numpy(np.int64), rows["value"].to_numpy(float)
        out = None
        if len(us):
            width, cut = 60_000_000, int(us[-1]) - self.span
            old = range(first // width, min(last, cut) // width + 1) if n else range(0)  # the minutes in which rows fall out now
            parts = [self._minute(m) for m in old]
            old_us, old_values = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0))
            inside = old_us >= first
            leaving_us, leaving = np.concatenate([old_us[inside], us]), np.concatenate([old_values[inside], values])
            gone = np.searchsorted(leaving_us, us - self.span, side="right")
            fallen = np.concatenate([[0.0], np.cumsum(leaving)])
            sums, counts = total + np.cumsum(values) - fallen[gone], n + np.arange(1, len(us) + 1) - gone
            out = _table(key, self.keys, {"time": stamps(us), "value": sums / counts})
            for m, (own_us, _) in zip(old, parts, strict=True):
                if len(own_us) and (m + 1) * width <= cut + 1:
                    self.minutes.removeKey((m,))
            stays = us > cut
            for m in np.unique(us[stays] // width):
                own_us, own_values = self._minute(int(m))
                new = stays & (us // width == m)
                self.minutes.updateValue((int(m),), (np.concatenate([own_us, us[new]]).tolist(), np.concatenate([own_values, values[new]]).tolist()))
            n, total, first, last = int(counts[-1]), float(sums[-1]), cut + 1, int(us[-1])
            if n == int(stays.sum()):  # only new rows are left: their sum, without what rounding has gathered
                total = float(values[stays].sum())
            self.state.update((total, n, first, last))
        if n and last + self.span < until:
            self.minutes.clear()
            self.state.clear()
            return out, None
        return out, last + self.span + 1000 if n else None


def history(points: DataFrame, keys: list[str], minutes: float = 35, late: str = "10 seconds") -> DataFrame:
    """(keys, time, value): for each arrival the mean of its series over the last minutes."""
    processor = History(minutes * 60)
    processor.keys = keys
    return applied(points, keys, processor, "time timestamp, value double", late)


class Recent(InOrder):
    """The last ``shown`` of the last ``most`` alerts whenever one comes; one that came within ``expiry`` seconds is not taken again."""

    columns = {"alert": "string"}  # noqa: RUF012
    own_state = "us array<long>, alert array<string>"

    def __init__(self, most: int, shown: int, expiry: float) -> None:
        self.most, self.shown, self.expiry = most, shown, int(expiry * 1e6)

    def advance(self, key: tuple, rows: pd.DataFrame, until: int) -> tuple[pd.DataFrame | None, int | None]:
        times, names = (list(x) for x in self.get(([], [])))
        last = dict(zip(names, times, strict=True))
        out = []
        for us, name in rows.itertuples(index=False):
            if name in last and us - last[name] < self.expiry:
                continue
            last[name] = us
            times, names = [*times, us][-self.most :], [*names, name][-self.most :]
            out.append((us, names[-self.shown :]))
        if out:
            self.state.update((times, names))
        return _table(key, self.keys, {"time": stamps([t for t, _ in out]), "alerts": [n for _, n in out]}), None


def recent(alerts: DataFrame, keys: list[str], most: int = 50, shown: int = 10, expiry: float = 600, late: str = "10 seconds") -> DataFrame:
    processor = Recent(most, shown, expiry)
    processor.keys = keys
    return applied(alerts, keys, processor, "time timestamp, alerts array<string>", late)


class Outbox(InOrder):
    """A queue of at most ``most`` messages that drops its oldest when full, and tries all it holds every ``every`` seconds.

    ``send`` gets texts and says which were taken; a micro-batch that is tried again calls it again, so it sees a message
    at least once. A message goes after ``tries`` failures.
    """

    columns = {"text": "string"}  # noqa: RUF012
    own_state = "tick long, text array<string>, failed array<int>"

    def __init__(self, send: Callable[[list[str]], list[bool]], most: int, tries: int, every: float) -> None:
        self.send, self.most, self.tries, self.every = send, most, tries, int(every * 1e6)

    def advance(self, key: tuple, rows: pd.DataFrame, until: int) -> tuple[pd.DataFrame | None, int | None]:
        tick, texts, failed = (list(x) if isinstance(x, (list, np.ndarray)) else x for x in self.get((-1, [], [])))
        queue, out = list(zip(texts, failed, strict=True)), []

        def drain(before: int) -> None:
            nonlocal queue, tick
            while queue and tick < before:
                left = []
                for (text, n), taken in zip(queue, self.send([t for t, _ in queue]), strict=True):
                    if taken:
                        out.append((tick, text, "sent", n))
                    elif n + 1 >= self.tries:
                        out.append((tick, text, "given up", n + 1))
                    else:
                        left.append((text, n + 1))
                queue = left
                tick += self.every

        for us, text in rows.itertuples(index=False):
            drain(us)
            if not queue:
                tick = us + self.every
            elif len(queue) == self.most:
                out.append((us, queue[0][0], "dropped", queue[0][1]))
                queue = queue[1:]
            queue.append((text, 0))
        drain(until + 1)
        if queue:
            self.state.update((tick, [t for t, _ in queue], [n for _, n in queue]))
        else:
            self.state.clear()
        columns = {"time": stamps([t for t, *_ in out]), "text": [x for _, x, *_ in out], "outcome": [o for *_, o, _ in out], "failed": [n for *_, n in out]}
        return _table(key, self.keys, columns), tick if queue else None


def outbox(messages: DataFrame, keys: list[str], send: Callable[[list[str]], list[bool]], most: int = 20, tries: int = 3, every: float = 30, late: str = "5 seconds") -> DataFrame:
    """(keys, time, text, outcome, failed): messages as they are sent, dropped or given up."""
    processor = Outbox(send, most, tries, every)
    processor.keys = keys
    return applied(messages, keys, processor, "time timestamp, text string, outcome string, failed int", late)


# ---- waves

class Waves(InOrder):
    """Heave through a first-order high-pass, folded in order; every ``step`` seconds four standard deviations over ``width`` seconds.

    The state holds the filter's last input and output, and for each step the number, sum and sum of squares of its samples.
    """

    own_state = "x double, y double, tick long, n array<long>, s array<double>, q array<double>"

    def __init__(self, cut_hz: float, rate_hz: float, width: float, step: float) -> None:
        rc = 1 / (2 * np.pi * cut_hz)
        self.keep, self.step, self.bins = rc / (rc + 1 / rate_hz), int(step * 1e6), round(width / step)

    def advance(self, key: tuple, rows: pd.DataFrame, until: int) -> tuple[pd.DataFrame | None, int | None]:
        x, y, tick, *bins = self.get((np.nan, 0.0, -1, [], [], []))
        bins = [np.array(b, float) for b in bins]
        rows = rows.dropna()
        us, values = rows["us"].to_numpy(np.int64), rows["value"].to_numpy(float)
        passed = high_passed(values, self.keep, x, y)
        if len(us):
            x, y = float(values[-1]), float(passed[-1])
            tick = tick if tick >= 0 else int(us[0]) // self.step
        if tick < 0:
            return None, None
        # Steps that the watermark has passed are whole; the last one may go on.
        place = us // self.step - tick
        last = max(until // self.step - 1, tick - 1)
        size = int(max(place.max() + 1 if len(us) else 0, len(bins[0]) - self.bins + 1 if len(bins[0]) else 0, last - tick + 1, 1))
        fresh = [np.bincount(place, weights=w, minlength=size) for w in (np.ones(len(us)), passed, passed * passed)]
        past = self.bins - 1  # whole steps before ``tick`` that are still in a window
        old = [b[:past] if len(b) else np.zeros(past) for b in bins]
        for k, b in enumerate(bins):
            if len(b) > past:
                fresh[k][: len(b) - past] += b[past:]
        n, s, q = (np.concatenate([o, f]) for o, f in zip(old, fresh, strict=True))
        whole = int(last - tick + 1)
        sums = [np.convolve(v, np.ones(self.bins), "valid")[:whole] for v in (n, s, q)]
        several = sums[0] > 1
        with np.errstate(divide="ignore", invalid="ignore"):
            height = 4 * np.sqrt(np.maximum(sums[2] - sums[1] ** 2 / sums[0], 0) / (sums[0] - 1))
        ends = (tick + 1 + np.arange(whole)) * self.step
        out = _table(key, self.keys, {"time": stamps(ends[several]), "height": height[several]})
        left = [v[whole:] for v in (n, s, q)]
        if not left[0].any():
            self.state.clear()
            return out, None
        self.state.update((x, y, int(tick + whole), left[0].astype(np.int64).tolist(), left[1].tolist(), left[2].tolist()))
        return out, (tick + whole + 1) * self.step + 1000


def high_passed(values: np.ndarray, keep: float, x: float = np.nan, y: float = 0.0) -> np.ndarray:
    """y[i] = keep (y[i - 1] + x[i] - x[i - 1]) after the given last input and output; without them the first output is 0."""
    if not len(values):
        return np.zeros(0)
    steps = np.diff(values, prepend=values[0] if np.isnan(x) else x)
    fed = np.concatenate([[y], keep * steps / (1 - keep)])
    return pd.Series(fed).ewm(alpha=1 - keep, adjust=False).mean().to_numpy()[1:]


def waves(heave: DataFrame, keys: list[str], cut_hz: float = 0.05, rate_hz: float = 10.0, width: float = 600, step: float = 5, late: str = "10 seconds") -> DataFrame:
    """(keys, time, height): significant height of each window, at its end."""
    processor = Waves(cut_hz, rate_hz, width, step)
    processor.keys = keys
    return applied(heave, keys, processor, "time timestamp, height double", late)
