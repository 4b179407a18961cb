"""The transforms as streams. Each takes a streaming frame of points with a zoned ``time`` and gives a streaming
frame; callers start it with a checkpoint folder. Bounded replays with ``availableNow`` give the batch results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def downsampled(points: DataFrame, keys: list[str], every: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """The last value of each series in each window, once the watermark has passed it."""
    w = F.window("time", every)
    return points.withWatermark("time", late).groupBy(w.alias("w"), *keys).agg(F.max_by("value", "time").alias("value")).select(F.col("w.end").alias("time"), *keys, "value")


def window_means(points: DataFrame, keys: list[str], every: str, late: str = "1 minute") -> DataFrame:
    w = F.window("time", every)
    return points.withWatermark("time", late).groupBy(w.alias("w"), *keys).agg(F.avg("value").alias("value")).select(F.col("w.end").alias("time"), *keys, "value")


def wave_windows(points: DataFrame, keys: list[str], width: str = "10 minutes", step: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    w = F.window("time", width, step)
    return points.withWatermark("time", late).groupBy(w.alias("w"), *keys).agg((4 * F.stddev_samp("value")).alias("height")).select(F.col("w.end").alias("time"), *keys, "height")


def once(rows: DataFrame, key: str, within: str = "1 day") -> DataFrame:
    """The first row of each key, such as a date or an alert's key."""
    return rows.withWatermark("time", within).dropDuplicatesWithinWatermark([key])


def latest_values(points: DataFrame, keys: list[str]) -> DataFrame:
    """The latest-value tree, in complete or update mode."""
    return points.groupBy(*keys).agg(F.max_by("value", "time").alias("value"), F.max("time").alias("time"))


def smoothed_stream(points: DataFrame, key: str, alpha: float = 0.05) -> DataFrame:
    """Exponential smoothing by arrival; the state of a series is its last smoothed value. Rows without a number give none and leave it as it is."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).dropna(subset=["time", "value"]).sort_values("time")
        value = state.get[0] if state.exists else None
        out = []
        for x in pdf["value"]:
            value = x if value is None else value * (1 - alpha) + x * alpha
            out.append(value)
        if value is not None:
            state.update((value,))
        yield pd.DataFrame({key: [group[0]] * len(out), "time": pdf["time"].to_numpy(), "value": out})

    kind = points.schema[key].dataType.simpleString()
    return points.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, time timestamp, value double", "value double", "append", GroupStateTimeout.NoTimeout)


def history(points: DataFrame, key: str, minutes: int = 35) -> DataFrame:
    """For each arrival the mean over the series' last minutes; older rows leave the state."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values("time")
        times, values = (list(x) for x in state.get) if state.exists else ([], [])
        out = []
        for t, v in zip(pdf["time"], pdf["value"], strict=True):
            times.append(t.timestamp())
            values.append(float(v))
            keep = [i for i, x in enumerate(times) if x > t.timestamp() - minutes * 60]
            times, values = [times[i] for i in keep], [values[i] for i in keep]
            out.append(sum(values) / len(values))
        state.update((times, values))
        yield pd.DataFrame({key: [group[0]] * len(out), "time": pdf["time"].to_numpy(), "value": out})

    kind = points.schema[key].dataType.simpleString()
    return points.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, time timestamp, value double", "times array<double>, values array<double>", "append", GroupStateTimeout.NoTimeout)


def held_alerts(points: DataFrame, key: str, limit: float, hold_seconds: int, late: str = "1 minute") -> DataFrame:
    """A row when a series has been over the limit for the hold, once for each stretch: (key, since, fired). A missing value is no breach and ends the stretch."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, fired = state.get if state.exists else (None, False)
        out = []
        for t, v in pd.concat(list(batches)).sort_values("time")[["time", "value"]].itertuples(index=False):
            at = t.timestamp()
            if pd.isna(v) or v <= limit:
                since, fired = None, False
                continue
            since = at if since is None else since
            if not fired and at - since >= hold_seconds:
                fired = True
                out.append((group[0], pd.Timestamp(since, unit="s"), t))
        state.update((since, fired))
        yield pd.DataFrame(out, columns=[key, "since", "fired"])

    kind = points.schema[key].dataType.simpleString()
    return points.withWatermark("time", late).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, since timestamp, fired timestamp", "since double, fired boolean", "append", GroupStateTimeout.NoTimeout)


def throttled(alerts: DataFrame, key: str, seconds: int = 1800) -> DataFrame:
    """At most one alert of a key in the interval, by event time."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for t in pd.concat(list(batches))["time"].sort_values():
            if last is None or t.timestamp() - last >= seconds:
                last = t.timestamp()
                out.append((group[0], t))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=[key, "time"])

    kind = alerts.schema[key].dataType.simpleString()
    return alerts.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, time timestamp", "last double", "append", GroupStateTimeout.NoTimeout)


def heartbeat(points: DataFrame, key: str, every_seconds: int = 120) -> DataFrame:
    """Re-emits each series' last value when none has come for the interval (processing time)."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            value = state.get[0]
            yield pd.DataFrame({key: [group[0]], "value": [value], "fresh": [False]})
        else:
            pdf = pd.concat(list(batches)).sort_values("time")
            value = float(pdf["value"].iloc[-1])
            yield pd.DataFrame({key: [group[0]], "value": [value], "fresh": [True]})
        state.update((value,))
        state.setTimeoutDuration(every_seconds * 1000)

    kind = points.schema[key].dataType.simpleString()
    return points.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, value double, fresh boolean", "value double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def appended(df: DataFrame, root: str, checkpoint: str, every: str | None = None) -> object:
    """Writes each micro-batch to a folder of its own in a partitioned table; a batch that is tried again replaces its folder.

    Without ``every`` what is there now is taken and the query ends.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={number}")

    when = {"availableNow": True} if every is None else {"processingTime": every}
    return df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**when).start()


def ticks(rate: DataFrame, compute: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, every: str) -> object:
    """The fixed-tick loop: on each trigger, ``compute`` reads the latest inputs and its result goes into the tick's folder; a tick that is tried again replaces it."""

    def put(batch: DataFrame, number: int) -> None:
        compute(batch).write.mode("overwrite").parquet(f"{out}/tick={number}")

    return rate.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
