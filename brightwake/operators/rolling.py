"""Row windows over series: moving figures, trends, changes, durations, records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from brightwake.functions.angles import difference


def span(by: list[str], time: str, interval: str) -> WindowSpec:
    """The rows of the group within the interval up to the current row."""
    seconds = F.col(time).cast("timestamp").cast("double")
    return Window.partitionBy(*by).orderBy(seconds).rangeBetween(-interval_seconds(interval), 0)


def interval_seconds(interval: str) -> int:
    """Of texts such as '5 minutes'."""
    n, unit = interval.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def moving(df: DataFrame, by: list[str], value: str, interval: str, out: str, how: str = "mean", time: str = "time") -> DataFrame:
    fn = {"mean": F.avg, "stddev": F.stddev_samp, "min": F.min, "max": F.max, "count": F.count}[how]
    return df.withColumn(out, fn(value).over(span(by, time, interval)))


def change(df: DataFrame, by: list[str], value: str, interval: str, out: str, angle: bool = False, time: str = "time") -> DataFrame:
    """Last less first of the interval before each row; on the circle for angles."""
    first = F.first(value).over(span(by, time, interval))
    return df.withColumn(out, difference(F.col(value), first) if angle else F.col(value) - first)


def half_trend(df: DataFrame, by: list[str], value: str, least: int = 4, step: float = 0.2, time: str = "time") -> DataFrame:
    """Mean of the later half of a group's rows less that of the earlier; null under ``least`` rows."""
    w = Window.partitionBy(*by)
    placed = df.withColumns({"__i": F.row_number().over(w.orderBy(time)), "__n": F.count(F.lit(1)).over(w)})
    early = F.col("__i") <= F.floor(F.col("__n") / 2)
    d = F.avg(F.when(~early, F.col(value))) - F.avg(F.when(early, F.col(value)))
    out = placed.groupBy(*by).agg(F.max("__n").alias("n"), d.alias("change"))
    label = F.when(F.col("n") < least, F.lit(None)).when(F.col("change") > step, "up").when(F.col("change") < -step, "down").otherwise("flat")
    return out.withColumn("trend", label)


def two_ranges(df: DataFrame, by: list[str], value: str, asof: Column, near: str, far: str, time: str = "time") -> DataFrame:
    """Latest value of the last ``near``, of the stretch before it back to ``far``, and their difference: one aggregate."""
    t = F.col(time)
    a, b = asof - F.expr(f"interval {near}"), asof - F.expr(f"interval {far}")
    late, early = (t >= a) & (t < asof), (t >= b) & (t < a)
    pick = lambda c: F.max_by(F.when(c, F.col(value)), F.when(c, t))
    return df.filter((t >= b) & (t < asof)).groupBy(*by).agg(pick(late).alias("now"), pick(early).alias("before")).withColumn("change", F.col("now") - F.col("before"))


def durations(df: DataFrame, by: list[str], who: str, asof: Column, time: str = "time") -> DataFrame:
    """Seconds between each change and the next, summed by ``who``; the last one runs up to ``asof``."""
    w = Window.partitionBy(*by).orderBy(time)
    held = df.withColumn("__us", F.unix_micros(F.coalesce(F.lead(time).over(w), asof)) - F.unix_micros(time))
    return held.groupBy(*by, who).agg((F.sum("__us") / 1e6).alias("seconds"), F.count(F.lit(1)).alias("turns"))


def records(df: DataFrame, by: list[str], value: str, margin: float, time: str = "time") -> DataFrame:
    """Rows that beat all earlier ones of their group by more than the margin."""
    before = F.max(value).over(Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("previous_best", before).filter(F.col(value) > F.col("previous_best") + margin)


def crossings(df: DataFrame, by: list[str], value: str, time: str = "time") -> DataFrame:
    """Rows where the value's sign differs from that of the row before."""
    w = Window.partitionBy(*by).orderBy(time)
    return df.withColumn("__before", F.lag(F.signum(value)).over(w)).filter((F.col("__before") != F.signum(value)) & (F.signum(value) != 0)).drop("__before")


def smoothed(df: DataFrame, by: list[str], value: str, alpha: float, out: str, time: str = "time") -> DataFrame:
    """Exponential smoothing with weight ``alpha`` over all rows of a group, by time; a null keeps the last figure.

    A task takes its groups sorted, in Arrow batches, and carries the last figure from each batch into the next, so
    a group of any length needs little memory.
    """
    plain = df.drop(out)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, np.nan
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            figures = np.empty(len(pdf))
            for own, part in pdf.groupby(by, sort=False, dropna=False) if by else [((), pdf)]:
                own = tuple(None if pd.isna(x) else x for x in own)
                carried = last if own == key else np.nan
                values = pd.Series(np.concatenate([[carried], part[value].to_numpy(dtype=float, na_value=np.nan)]))
                found = values.ewm(alpha=alpha, adjust=False, ignore_na=True).mean().to_numpy()
                figures[part.index.to_numpy()] = found[1:]
                key, last = own, found[-1]
            yield pdf.assign(**{out: figures})

    dealt = plain.repartition(*by) if by else plain.repartition(1)
    return dealt.sortWithinPartitions(*by, time).mapInPandas(fold, StructType([*plain.schema.fields, StructField(out, DoubleType())]))
