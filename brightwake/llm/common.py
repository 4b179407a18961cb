"""Small helpers that several training-data operators share."""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

T = TypeVar("T")

#: Marks the leading bits of monotonically_increasing_id(): the partition's number.
_PARTITION_SHIFT = 33


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Only a session in local mode may leave the setting empty; it gets a temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that ``df`` has no column of yet, made from these; Spark takes no account of case."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def quoted(name: str) -> str:
    """A column's name as it stands, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this run has written in the shared folder and is done with."""
    if not path.startswith(f"{shared_folder(spark)}/"):
        raise ValueError(f"{path} is not in the shared folder")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that lost executors cost no recomputation.

    The files go when the driver has no more use for ``df``, if the session sets
    ``spark.cleaner.referenceTracking.cleanCheckpoints``, which long sessions over much data should.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def joined_by(rows: DataFrame, table: DataFrame, key: str, count: str, heavy: float = 1e-4) -> DataFrame:
    """``rows`` joined with ``table``, which has each ``key`` once and, as ``count``, how many rows have it.

    A key that many rows share would send all of them to one task. Keys that have more than the share ``heavy`` of all
    rows, 1 / ``heavy`` at most, are broadcast, so that their rows stay where they are; the others are shuffled.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    large = F.col(count) > max(1, heavy * total)
    most, rest = table.filter(large).drop(count), table.filter(~large).drop(count)
    if most.isEmpty():
        return rows.join(rest, key)
    return rows.join(F.broadcast(most), key).unionByName(rows.join(F.broadcast(most.select(key)), key, "left_anti").join(rest, key))


def with_rank(df: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """Adds ``out``: each row's gapless rank from 0 within its ``group``, in ``order``.

    A window over the group would put all rows of a hot group into one task. Here rows are dealt by
    ranges of (group, order), so that a hot group spreads over many partitions; within one partition a
    group's rows are neighbours, and their rank is their row number less that of the first, plus the
    rows that earlier partitions hold. What is broadcast has a row for each group and one more for each
    partition at most; callers keep the number of groups bounded. ``group`` must not be null. Rows that
    tie in ``order`` get their ranks in any order; the result is frozen by a checkpoint.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    row, part, first, n, base = fresh(df, "row", "part", "first", "n", "base")
    placed = durable(
        df.repartitionByRange(parts, group, *order)
        .sortWithinPartitions(group, *order)
        .withColumn(row, F.monotonically_increasing_id())
    ).withColumn(part, F.shiftright(row, _PARTITION_SHIFT))
    spans = placed.groupBy(group, part).agg(F.min(row).alias(first), F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn(base, F.coalesce(F.sum(n).over(before), F.lit(0)) - F.col(first))
    return (
        placed.join(F.broadcast(spans.select(group, part, base)), [group, part])
        .withColumn(out, F.col(row) + F.col(base))
        .drop(row, part, base)
    )


def size_bin(size: Column, exact_below: int, per_octave: int) -> Column:
    """A bin for each size: exact below ``exact_below``, then ``per_octave`` bins for each doubling.

    Sizes are 64-bit, so there are at most exact_below + 64 * per_octave bins.
    """
    steps = F.floor(F.log2(size.cast("double") / exact_below) * per_octave)
    return F.when(size < exact_below, size).otherwise(F.lit(exact_below) + F.greatest(steps, F.lit(0))).cast("long")


def shared(spark: SparkSession, thing: T) -> Callable[[], T]:
    """Broadcasts an object of bounded size; the function gives it back inside a task, its class with it."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(thing))
    return lambda: pickle.loads(sent.value)


def byte_slices(batch: pa.RecordBatch, column: str, most: int = 1 << 22) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of a binary column, about ``most`` bytes each (a longer row stands alone).

    Gives (first row, row after the last, the bytes of all as uint8, the rows' offsets in them).
    Null rows count as empty.
    """
    values = batch.column(batch.schema.get_field_index(column))
    if values.null_count:
        values = values.fill_null(b"")
    values = values.cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2], dtype=np.uint8) if values.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(values):
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(max(b, a + 1), len(values))
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def united(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Union-find over edges (u, v), many at a time: the root of each of n nodes, its component's smallest node.

    Each round hangs the larger of two roots under the smaller (of several unions of one root one is made, the
    others' edges stay open) and follows the parents of the edges that are still open.
    """
    parent = np.arange(n)
    while len(u):
        small, large = np.minimum(u, v), np.maximum(u, v)
        parent[large] = small
        for ends in (small, large):
            while True:
                up = parent[ends]
                if np.array_equal(up, ends):
                    break
                ends[:] = up
        still = small != large
        u, v = small[still], large[still]
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up
