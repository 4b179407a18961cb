"""Row windows over series of any length: time is cut into buckets, and each bucket of a series is a task of its own.

What a bucket has to know of the rest comes to it as rows: a halo of rows that lie within the window's length before
it, or one opening (or closing) row that holds the state which earlier (or later) buckets hand on. Those states are a row
for each bucket, found by an aggregate and handed on by a window over the buckets of a series, which are few. So every
operator here takes one shuffle of its rows and one of the bucket table, and gives what its form over whole series gives.

``by`` may be empty. Null keys are a key. Rows without a time belong to no bucket and go. Rows that tie in ``time`` follow ``order``, further
columns that decide. Names that begin with two underscores are the operators' own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from brightwake.operators.rolling import interval_seconds

_B, _FLAG = "__bucket", "__flag"


def _us(interval: str) -> int:
    return interval_seconds(interval) * 1_000_000


def _floor(us: Column, length: int) -> Column:
    """The quotient of whole numbers, rounded down; exact, unlike a division of doubles."""
    return ((us - F.pmod(us, F.lit(length))) / length).cast("long")


def _bucket(time: str, length: int) -> Column:
    return _floor(F.unix_micros(time), length)


def moving(df: DataFrame, by: list[str], values: dict[str, Column | tuple[str, Column | str]], interval: str, strict: bool = True, time: str = "time", bucket: str | None = None) -> DataFrame:
    """``values``: aggregates over the rows of the interval that ends with each row, its own time included.

    Those given as (mean, sum, count, min or max; column) are worked out in time that grows with the rows, however many an
    interval has. Any other aggregate is taken afresh over each row's interval, so its time grows with rows times rows in an
    interval. ``strict`` leaves out what lies exactly the interval back. ``bucket`` counts for the latter only; without it
    a bucket has four times the interval, so that a row is copied into one further bucket at most, and a quarter of the rows are.
    """
    known = {name: v for name, v in values.items() if isinstance(v, tuple)}
    if known:
        df = _moving_in_parts(df, by, known, interval, strict, time)
        values = {name: c for name, c in values.items() if name not in known}
        if not values:
            return df
    width = _us(interval)
    length = _us(bucket) if bucket else 4 * width
    reach = width - 1 if strict else width
    us = F.unix_micros(time)
    spread = df.withColumn("__us", us).withColumn("__own", _bucket(time, length)).withColumn(_B, F.explode(F.sequence("__own", _floor(F.col("__us") + reach, length))))
    w = Window.partitionBy(*by, _B).orderBy("__us").rangeBetween(-reach, 0)
    return spread.withColumns({name: c.over(w) for name, c in values.items()}).filter(F.col(_B) == F.col("__own")).drop("__us", "__own", _B)


def _moving_in_parts(df: DataFrame, by: list[str], values: dict[str, tuple[str, Column | str]], interval: str, strict: bool, time: str) -> DataFrame:
    """Buckets have the interval's length, so an interval is the end of one bucket and the beginning of the next: each is a running figure.

    Rows are copied into the bucket after theirs under the last time whose interval has them, with nothing but what is counted. From the
    latest time back they add up to the ends, and the bucket's own rows from its first time on to the beginnings. Nothing is
    subtracted, so no figure loses precision, and a value that is not a number spoils only its own intervals.
    """
    length = _us(interval)
    reach = length - 1 if strict else length
    args = {f"__v{i}": (F.col(c) if isinstance(c, str) else c) for i, (_, c) in enumerate(values.values())}
    rows = df.filter(F.col(time).isNotNull()).withColumns({n: c.cast("double") if how == "mean" else c for (n, c), (how, _) in zip(args.items(), values.values(), strict=True)})
    rows = rows.withColumns({"__key": F.unix_micros(time), _B: _bucket(time, length), _FLAG: F.lit(1)})
    halo = rows.select(*by, *args, (F.col("__key") + reach).alias("__key"), (F.col(_B) + 1).alias(_B), F.lit(0).alias(_FLAG)).filter(F.col("__key") >= F.col(_B) * length)
    both = rows.unionByName(halo, allowMissingColumns=True)
    w = Window.partitionBy(*by, _B)
    ends = {1: w.orderBy("__key").rangeBetween(Window.unboundedPreceding, Window.currentRow), 0: w.orderBy(F.desc("__key")).rangeBetween(Window.unboundedPreceding, Window.currentRow)}
    parts, out = {}, {}
    for (name, (how, _)), v in zip(values.items(), args, strict=True):
        for fn in {"mean": ("sum", "count")}.get(how, (how,)):
            for flag, over in ends.items():
                parts[f"{v}_{fn}{flag}"] = getattr(F, fn)(F.when(F.col(_FLAG) == flag, F.col(v))).over(over)
        two = lambda fn, v=v: [F.col(f"{v}_{fn}{flag}") for flag in ends]
        total = lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
        if how == "mean":
            n = two("count")[0] + two("count")[1]
            out[name] = F.when(n > 0, total(*two("sum")) / n)
        else:
            out[name] = {"sum": total, "count": lambda a, b: a + b, "min": F.least, "max": F.greatest}[how](*two(how))
    done = both.withColumns(parts).filter(F.col(_FLAG) == 1)
    return done.withColumns(out).select(*(c for c in df.columns if c not in out), *out)


def _cut(df: DataFrame, time: str, bucket: str) -> DataFrame:
    return df.filter(F.col(time).isNotNull()).withColumn(_B, _bucket(time, _us(bucket)))


def _handed(states: DataFrame, by: list[str], names: dict[str, Column], back: bool = True) -> DataFrame:
    """What the buckets before (or, not ``back``, after) hand to each; ``names`` are expressions over a window of them."""
    w = Window.partitionBy(*by).orderBy(F.col(_B).asc() if back else F.col(_B).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return states.select(*by, _B, *(c.over(w).alias(n) for n, c in names.items()))


def neighbours(df: DataFrame, by: list[str], columns: list[str], ahead: bool = False, time: str = "time", order: tuple[str, ...] = (), bucket: str = "1 hour") -> DataFrame:
    """Each row with ``columns`` of the row before it in its series, as ``<column>_before``; with ``ahead`` of the next one, as ``<column>_next``."""
    rows, tag = _cut(df, time, bucket), "next" if ahead else "before"
    place, whole = F.struct(time, *order), F.struct(*(F.col(c).alias(f"c{k}") for k, c in enumerate(columns)))
    edge = (F.min_by if ahead else F.max_by)(whole, place).alias("__edge")
    states = rows.groupBy(*by, _B).agg(edge)
    handed = _handed(states, by, {"__edge": F.last("__edge")}, back=not ahead).filter("__edge is not null")
    # The edge row comes last of all where it is ahead, else first.
    both = rows.withColumn("__here", whole).withColumn(_FLAG, F.lit(1)).unionByName(handed.select(*by, _B, F.col("__edge").alias("__here"), F.lit(2 if ahead else 0).alias(_FLAG)), allowMissingColumns=True)
    w = Window.partitionBy(*by, _B).orderBy(_FLAG, time, *order)
    seen = (F.lead if ahead else F.lag)("__here").over(w)
    out = both.withColumn("__seen", seen).filter(F.col(_FLAG) == 1)
    return out.withColumns({f"{c}_{tag}": F.col("__seen")[f"c{k}"] for k, c in enumerate(columns)}).drop(_B, _FLAG, "__here", "__seen")


def running(df: DataFrame, by: list[str], value: str, how: str, out: str, own: bool = True, time: str = "time", order: tuple[str, ...] = (), bucket: str = "1 hour") -> DataFrame:
    """The sum, min or max of all rows of the series up to each row, without itself unless ``own``."""
    fn = {"sum": F.sum, "max": F.max, "min": F.min}[how]
    rows = _cut(df, time, bucket)
    handed = _handed(rows.groupBy(*by, _B).agg(fn(value).alias("__state")), by, {"__x": fn("__state")})
    both = rows.withColumn("__x", F.col(value)).withColumn(_FLAG, F.lit(1)).unionByName(handed.filter("__x is not null").withColumn(_FLAG, F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*by, _B).orderBy(_FLAG, time, *order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    return both.withColumn(out, fn("__x").over(w)).filter(F.col(_FLAG) == 1).drop(_B, _FLAG, "__x")


def records(df: DataFrame, by: list[str], value: str, margin: float, time: str = "time", order: tuple[str, ...] = (), bucket: str = "1 day") -> DataFrame:
    """As ``rolling.records``: rows that beat all earlier ones of their group by more than the margin."""
    return running(df, by, value, "max", "previous_best", False, time, order, bucket).filter(F.col(value) > F.col("previous_best") + margin)


def durations(df: DataFrame, by: list[str], who: str, asof: Column, time: str = "time", order: tuple[str, ...] = (), bucket: str = "1 day") -> DataFrame:
    """As ``rolling.durations``: seconds between each change and the next, summed by ``who``."""
    held = neighbours(df, by, [time], True, time, order, bucket).withColumn("__us", F.unix_micros(F.coalesce(f"{time}_next", asof)) - F.unix_micros(time))
    return held.groupBy(*by, who).agg((F.sum("__us") / 1e6).alias("seconds"), F.count(F.lit(1)).alias("turns"))


def half_trend(df: DataFrame, by: list[str], value: str, least: int = 4, step: float = 0.2, time: str = "time", order: tuple[str, ...] = (), bucket: str = "1 day") -> DataFrame:
    """As ``rolling.half_trend``: mean of the later half of a group's rows less that of the earlier.

    Only the bucket in which the middle lies has to tell its rows apart; of the others sums are enough.
    """
    rows = _cut(df, time, bucket)
    sizes = rows.groupBy(*by, _B).agg(F.count(F.lit(1)).alias("__n"))
    placed = sizes.withColumn("__all", F.sum("__n").over(Window.partitionBy(*by))).withColumn("__upto", F.sum("__n").over(Window.partitionBy(*by).orderBy(_B)))
    opening = placed.select(*by, _B, (F.col("__upto") - F.col("__n")).alias("__first"), F.col("__all").alias("__all"), F.lit(0).alias(_FLAG))
    both = rows.withColumn(_FLAG, F.lit(1)).unionByName(opening, allowMissingColumns=True)
    w = Window.partitionBy(*by, _B).orderBy(_FLAG, time, *order)
    at = F.row_number().over(w) - 1 + F.max("__first").over(w)  # from 1
    numbered = both.withColumns({"__at": at, "__of": F.max("__all").over(w)}).filter(F.col(_FLAG) == 1)
    early = F.col("__at") <= F.floor(F.col("__of") / 2)
    d = F.avg(F.when(~early, F.col(value))) - F.avg(F.when(early, F.col(value)))
    out = numbered.groupBy(*by).agg(F.max("__of").alias("n"), d.alias("change"))
    label = F.when(F.col("n") < least, F.lit(None)).when(F.col("change") > step, "up").when(F.col("change") < -step, "down").otherwise("flat")
    return out.withColumn("trend", label)


def recurrence(df: DataFrame, by: list[str], value: str, keep: float, gain: float, out: str, first: bool, time: str = "time", order: tuple[str, ...] = (), bucket: str = "1 hour") -> DataFrame:
    """y[i] = keep y[i - 1] + gain x[i] over each series; a null x keeps the last y.

    With ``first`` the y before the first row is that row's x, else 0. Each bucket folds its rows as if it began at 0, in Arrow
    batches; since the recurrence is linear, the y that comes before a bucket only adds itself times a power of ``keep``.
    """
    rows = _cut(df.drop(out), time, bucket)
    keys = [*by, _B]
    names = [f.name for f in rows.schema.fields]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, last, seen = None, 0.0, 0
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            figures, counts = np.empty(len(pdf)), np.empty(len(pdf), np.int64)
            for own, part in pdf.groupby(keys, sort=False, dropna=False):
                own = tuple(None if pd.isna(x) else x for x in own)
                if own != held:
                    held, last, seen = own, 0.0, 0
                x = part[value].to_numpy(dtype=float, na_value=np.nan)
                y = pd.Series(np.concatenate([[last], x * gain / (1 - keep)])).ewm(alpha=1 - keep, adjust=False, ignore_na=True).mean().to_numpy()
                at = part.index.to_numpy()
                figures[at], counts[at] = y[1:], seen + np.cumsum(~np.isnan(x))
                last, seen = y[-1], int(counts[at[-1]])
            yield pdf.assign(__y=figures, __k=counts)

    schema = StructType([*rows.schema.fields, StructField("__y", DoubleType()), StructField("__k", LongType())])
    folded = rows.repartition(*keys).sortWithinPartitions(*keys, time, *order).mapInPandas(fold, schema)
    states = folded.groupBy(*keys).agg(F.max("__k").alias("__n"), F.max_by("__y", "__k").alias("__z"), F.min_by(F.when(F.col("__k") == 1, F.col(value)), F.when(F.col("__k") == 1, F.struct(time, *order))).alias("__x"))
    # A series' buckets, a few numbers each, are folded in their order.
    series = states.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(_B, "__n", "__z", "__x"))).alias("__s"))
    start = F.get(F.filter("__s", lambda s: s["__n"] > 0), F.lit(0))["__x"].cast("double") if first else F.lit(0.0)
    step = lambda acc, s: F.struct(
        (acc["y"] * F.pow(F.lit(float(keep)), s["__n"]) + s["__z"]).alias("y"), (acc["n"] + s["__n"]).alias("n"), F.concat(acc["all"], F.array(F.struct(s[_B].alias(_B), acc["y"].alias("__before"), (acc["n"] > 0).alias("__seen")))).alias("all")
    )
    empty = F.array().cast(f"array<struct<{_B}:bigint,__before:double,__seen:boolean>>")
    handed = series.select(*by, F.inline(F.aggregate("__s", F.struct(start.alias("y"), F.lit(0).cast("long").alias("n"), empty.alias("all")), step)["all"]))
    both = folded.withColumn(_FLAG, F.lit(1)).unionByName(handed.withColumn(_FLAG, F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*keys)
    y = F.col("__y") + F.max("__before").over(w) * F.pow(F.lit(float(keep)), F.col("__k"))
    done = both.withColumn(out, F.when((F.col("__k") > 0) | F.max("__seen").over(w), y)).filter(F.col(_FLAG) == 1)
    return done.select(*[n for n in names if n != _B], out)


def smoothed(df: DataFrame, by: list[str], value: str, alpha: float, out: str, time: str = "time", order: tuple[str, ...] = (), bucket: str = "1 hour") -> DataFrame:
    """As ``rolling.smoothed``: exponential smoothing from the first value on."""
    return recurrence(df, by, value, 1 - alpha, alpha, out, True, time, order, bucket)


def high_passed(df: DataFrame, by: list[str], value: str, cut_hz: float, rate_hz: float, out: str, time: str = "time", order: tuple[str, ...] = (), bucket: str = "1 hour") -> DataFrame:
    """First-order high-pass of samples at a fixed rate: y[i] = keep (y[i - 1] + x[i] - x[i - 1]), from 0; rows without a value go."""
    rc = 1 / (2 * np.pi * cut_hz)
    keep = rc / (rc + 1 / rate_hz)
    rows = neighbours(df.filter(F.col(value).isNotNull()), by, [value], False, time, order, bucket)
    steps = rows.withColumn("__step", F.col(value) - F.coalesce(f"{value}_before", value)).drop(f"{value}_before")
    return recurrence(steps, by, "__step", keep, keep, out, False, time, order, bucket).drop("__step")


def wave_heights(df: DataFrame, by: list[str], value: str, cut_hz: float = 0.05, rate_hz: float = 10.0, width: int = 600, step: int = 5, time: str = "time", bucket: str = "1 hour") -> DataFrame:
    """Significant height at the end of each step: four standard deviations of the high-passed heave over ``width`` seconds.

    Each sample is summed into its step once; the windows run over steps, not over samples. Steps without a sample in their window, or with one, have no height.
    """
    passed = high_passed(df, by, value, cut_hz, rate_hz, "__passed", time, bucket=bucket)
    bins = passed.groupBy(*by, _bucket(time, step * 1_000_000).alias("__s")).agg(F.count(F.lit(1)).alias("__n"), F.sum("__passed").alias("__t"), F.sum(F.col("__passed") * F.col("__passed")).alias("__q"))
    # A step's sums reach as many windows as the width has steps; each window adds up what reaches it.
    reached = bins.withColumn("__s", F.explode(F.sequence(F.col("__s"), F.col("__s") + round(width / step) - 1)))
    ends = reached.groupBy(*by, "__s").agg(*(F.sum(c).alias(c) for c in ("__n", "__t", "__q"))).filter("__n > 1")
    spread = F.sqrt(F.greatest(F.col("__q") - F.col("__t") * F.col("__t") / F.col("__n"), F.lit(0.0)) / (F.col("__n") - 1))
    return ends.select(*by, F.timestamp_micros((F.col("__s") + 1) * (step * 1_000_000)).alias(time), (4 * spread).alias("height"))


def stretches(df: DataFrame, by: list[str], on: Column, time: str = "time", order: tuple[str, ...] = (), bucket: str = "1 day") -> DataFrame:
    """(by, since, ended): from the first row of each run in which ``on`` holds to the next row where it doesn't; null if there is none.

    Only the rows at which ``on`` turns, a series' turns together, meet in a task.
    """
    marked = df.select(*by, time, *order, F.coalesce(on, F.lit(False)).alias("__on"))
    turns = neighbours(marked, by, ["__on"], False, time, order, bucket).filter(F.col("__on") != F.coalesce("__on_before", F.lit(False)))
    ended = F.lead(time).over(Window.partitionBy(*by).orderBy(time, *order))
    return turns.withColumn("__ended", ended).filter("__on").select(*by, F.col(time).alias("since"), F.col("__ended").alias("ended"))


def together(parts: list[DataFrame], by: list[str], asof: Column) -> DataFrame:
    """(by, since, ended): when stretches of all ``parts`` hold at once; each is open at its end, and one that hasn't ended lasts to ``asof``.

    A sweep over starts and ends: the number of parts that hold is a running sum, and no stretch is joined with another. The
    stretches of one part don't overlap. Where a part ends at the instant at which it begins again, nothing changes.
    """
    marks = None
    for part in parts:
        closed = part.select(*by, "since", F.coalesce("ended", asof).alias("ended")).filter("since < ended")
        own = closed.select(*by, F.inline(F.array(F.struct(F.col("since").alias("time"), F.lit(1).alias("step")), F.struct(F.col("ended").alias("time"), F.lit(-1).alias("step")))))
        marks = own if marks is None else marks.unionByName(own)
    moves = marks.groupBy(*by, "time").agg(F.sum("step").alias("step")).filter("step <> 0")
    w = Window.partitionBy(*by).orderBy("time")
    return moves.select(*by, F.col("time").alias("since"), F.lead("time").over(w).alias("ended"), F.sum("step").over(w).alias("__on")).filter(F.col("__on") == len(parts)).drop("__on")
