"""Pipelines over point series: range, filter, last, mean, windows, pivots.

A pipeline carries its grouping columns, since every aggregate, sort and limit acts per group. Times are
always relative to an explicit as-of instant, so results can be repeated. Each step adds to one lazy plan;
ranges and measurements come first and reach the scan.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AGGREGATES = {"mean": F.avg, "count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "stddev": F.stddev_samp}


@dataclass(frozen=True)
class Series:
    df: DataFrame
    keys: tuple[str, ...] = ("measurement",)
    time: str = "time"
    value: str = "value"

    def _with(self, df: DataFrame) -> Series:
        return replace(self, df=df)

    def range(self, asof: Column, start: str, stop: str | None = None) -> Series:
        """From asof - start up to, not including, asof - stop; ``start`` is an interval such as '1 hour'."""
        t = F.col(self.time)
        upper = asof if stop is None else asof - F.expr(f"interval {stop}")
        return self._with(self.df.filter((t >= asof - F.expr(f"interval {start}")) & (t < upper)))

    def between(self, start: Column, stop: Column) -> Series:
        return self._with(self.df.filter((F.col(self.time) >= start) & (F.col(self.time) < stop)))

    def where(self, *conditions: Column) -> Series:
        df = self.df
        for c in conditions:
            df = df.filter(c)
        return self._with(df)

    def measurement(self, *names: str) -> Series:
        return self.where(F.col("measurement").isin(*names))

    def starting(self, prefix: str) -> Series:
        """Anchored name patterns; unlike a regular expression, a prefix is pushed to the scan."""
        return self.where(F.col("measurement").startswith(prefix))

    def matching(self, pattern: str) -> Series:
        return self.where(F.col("measurement").rlike(pattern))

    def map(self, value: Column) -> Series:
        return self._with(self.df.withColumn(self.value, value))

    def group(self, *keys: str) -> Series:
        return replace(self, keys=keys)

    def last(self) -> DataFrame:
        """Latest value of each group with its time; a scalar max_by, so it stays a hash aggregate."""
        return self.df.groupBy(*self.keys).agg(F.max_by(self.value, self.time).alias(self.value), F.max(self.time).alias(self.time))

    def first(self) -> DataFrame:
        return self.df.groupBy(*self.keys).agg(F.min_by(self.value, self.time).alias(self.value), F.min(self.time).alias(self.time))

    def aggregate(self, name: str) -> DataFrame:
        """By the aggregate's name; a group without rows gives no row."""
        return self.df.groupBy(*self.keys).agg(AGGREGATES[name](self.value).alias(self.value))

    def sort(self, *columns: Column) -> DataFrame:
        """Within each group, for output."""
        return self.df.repartition(*self.keys).sortWithinPartitions(*self.keys, *columns)

    def limit(self, n: int, *order: Column) -> DataFrame:
        """The first n rows of each group, numbered from 1. Spark keeps n of a group in each task before it shuffles."""
        w = Window.partitionBy(*self.keys).orderBy(*order)
        return self.df.withColumn("order", F.row_number().over(w)).filter(F.col("order") <= n)

    def pivot(self, row: list[str], column: str, names: list[str]) -> DataFrame:
        """Long to wide; the names are given, so that no job has to find them."""
        return self.df.groupBy(*row).pivot(column, names).agg(F.first(self.value, ignorenulls=True))

    def windows(self, every: str, name: str = "mean") -> DataFrame:
        """Tumbling windows with rows; the time of a window is its end."""
        w = F.window(self.time, every)
        return self.df.groupBy(*self.keys, w.alias("w")).agg(AGGREGATES[name](self.value).alias(self.value)).select(*self.keys, F.col("w.end").alias(self.time), self.value)

    def filled_windows(self, every: str, name: str = "mean", start: Column | None = None, stop: Column | None = None) -> DataFrame:
        """All windows of each group that reach into the range from ``start`` to ``stop``, for groups with a row in it; without a range
        from the group's first window to its last. Empty ones hold null, or 0 if counted."""
        found = (self if start is None else self.between(start, stop)).windows(every, name)
        step = F.expr(f"interval {every}")
        closes = lambda t: F.window(t, every)["end"]
        bounds = found.groupBy(*self.keys).agg(F.min(self.time).alias("__a"), F.max(self.time).alias("__b"))
        if start is not None:
            ends = found.sparkSession.range(1).select(start.alias("__x"), (stop - F.expr("interval 1 microsecond")).alias("__y"))
            first, last = ends.select(closes("__x"), F.col("__y")).first()[0], ends.select(closes("__y")).first()[0]
            bounds = bounds.select(*self.keys, F.lit(first).alias("__a"), F.lit(last).alias("__b"))
        grid = bounds.select(*self.keys, F.explode(F.sequence("__a", "__b", step)).alias(self.time))
        out = grid.join(found, [*self.keys, self.time], "left")
        return out.withColumn(self.value, F.coalesce(self.value, F.lit(0))) if name == "count" else out


def latest(df: DataFrame, names: dict[str, str], by: list[str] | None = None, name: str = "measurement", value: str = "value", time: str = "time") -> DataFrame:
    """The latest value of many measurements in one scan, a column for each: ``names`` maps columns to measurements."""
    hits = [F.max_by(F.when(F.col(name) == m, F.col(value)), F.when(F.col(name) == m, F.col(time))).alias(c) for c, m in names.items()]
    return df.filter(F.col(name).isin(*names.values())).groupBy(*(by or [])).agg(*hits)


def as_map(df: DataFrame, key: str = "measurement", value: str = "value", time: str = "time") -> DataFrame:
    """One row: measurement to latest value."""
    last = df.groupBy(key).agg(F.max_by(value, time).alias(value))
    return last.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias("latest"))


def stale(df: DataFrame, sensors: DataFrame, asof: Column, time: str = "time") -> DataFrame:
    """Each sensor of a small dimension (measurement, seconds) with whether it has been silent too long.

    The dimension is the left side, so that a sensor without any row counts as silent too.
    """
    seen = df.groupBy("measurement").agg(F.max(time).alias("last_seen"))
    silent = F.col("last_seen").isNull() | (F.col("last_seen") < asof - F.make_dt_interval(secs=F.col("seconds")))
    return sensors.join(seen, "measurement", "left").withColumn("stale", silent)
