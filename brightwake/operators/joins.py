"""Join-shaped operators: as-of combination, lookup tables by range, first fuzzy match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(ticks: DataFrame, readings: DataFrame, by: list[str], time: str = "time", value: str = "value") -> DataFrame:
    """Each tick with the latest reading of its group at or before it.

    One union and one window instead of a join by inequality; readings sort before ticks of the same time.
    ``by`` must divide the data: a group's rows are sorted in one task, which spills but doesn't split.
    """
    left = ticks.withColumn("__tick", F.lit(1))
    right = readings.select(*by, time, F.col(value).alias("__seen")).withColumn("__tick", F.lit(0))
    w = Window.partitionBy(*by).orderBy(time, "__tick").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right, allowMissingColumns=True).withColumn(value, F.last("__seen", ignorenulls=True).over(w))
    return both.filter("__tick = 1").drop("__tick", "__seen")


def asof_bucketed(ticks: DataFrame, readings: DataFrame, by: list[str], bucket: str, time: str = "time", value: str = "value") -> DataFrame:
    """As :func:`asof`, for groups of any size: time is cut into buckets, each its own task.

    A first pass finds, for each group and bucket, the last reading of the buckets before; it is put in
    front of the bucket as one more reading. That table has a row for each bucket only.
    """
    cut = lambda df: df.withColumn("__bucket", F.date_trunc(bucket, time))
    t, r = cut(ticks), cut(readings.select(*by, time, value))
    ends = r.groupBy(*by, "__bucket").agg(F.max_by(value, time).alias("__end"))
    keys = t.select(*by, "__bucket").distinct()
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = keys.join(ends, [*by, "__bucket"], "full").withColumn("__seen", F.last("__end", ignorenulls=True).over(before))
    opening = carried.filter("__seen is not null").select(*by, "__bucket", (F.col("__bucket") - F.expr("interval 1 microsecond")).alias(time), F.col("__seen").alias(value))
    return asof(t, r.unionByName(opening), [*by, "__bucket"], time, value).drop("__bucket")


def interpolated(df: DataFrame, at: str, table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``columns`` of a small lookup table, interpolated linearly at ``df[at]`` and clamped at both ends.

    The table is fixed and small (a polar has a dozen rows), so it is broadcast with the bounds beside each row.
    """
    w = Window.orderBy(key)
    steps = table.select(F.col(key).alias("__lo"), F.lead(key).over(w).alias("__hi"), F.row_number().over(w).alias("__first"), *(F.col(c).alias(f"__{c}0") for c in columns), *(F.lead(c).over(w).alias(f"__{c}1") for c in columns))
    x = F.col(at)
    inside = ((x >= F.col("__lo")) | (F.col("__first") == 1)) & ((x < F.col("__hi")) | F.col("__hi").isNull())
    share = F.when(F.col("__hi").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), (x - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))))
    joined = df.join(F.broadcast(steps), inside, "left")
    for c in columns:
        joined = joined.withColumn(c, F.col(f"__{c}0") + share * (F.coalesce(f"__{c}1", f"__{c}0") - F.col(f"__{c}0")))
    return joined.drop("__lo", "__hi", "__first", *(f"__{c}{k}" for c in columns for k in (0, 1)))


def first_contained(df: DataFrame, name: Column, ratings: dict[str, float]) -> DataFrame:
    """The rating of the first listed name that contains, or is contained in, the row's name, cases apart.

    The list is what a user entered; it becomes one array, so no join is needed.
    """
    rows = F.array(*(F.struct(F.lit(k.lower()).alias("k"), F.lit(float(v)).alias("v")) for k, v in ratings.items()))
    low = F.lower(name)
    fits = F.filter(rows, lambda r: low.contains(r["k"]) | r["k"].contains(low))
    return df.withColumn("rating", F.get(fits, F.lit(0))["v"])


def lookup(df: DataFrame, table: DataFrame, on: str, defaults: dict[str, object]) -> DataFrame:
    """Left join to a small dimension, with its default row for unknown keys."""
    return df.join(F.broadcast(table), on, "left").fillna(defaults)


def unsent(df: DataFrame, sent: DataFrame, key: str) -> DataFrame:
    return df.join(sent, key, "left_anti")
