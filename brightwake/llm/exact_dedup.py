"""Exact dedup by an exchange of Golomb-coded fingerprints.

1. Each text, its runs of white space made single spaces, gets a fingerprint below 256 times the number of rows. The rows go
   once into a table bucketed by the partition they are in, so that whatever is joined with them by partition comes
   to them, and they are never shuffled.
2. Each partition sorts its distinct fingerprints, cuts them at the borders of the owners' ranges, and sends every owner its
   run: the gaps in Golomb code, some ten bits each.
3. An owner decodes the runs it got and answers each with a bitmap: whether another partition sent that fingerprint too.
4. Each partition turns the bitmaps, and its own repeats, into one bit for each of its rows. Rows without the bit equal no other row
   and are done. The others, true copies and one row in 256 besides, are suspects.
5. Suspects are grouped by the bytes of their texts, copies in one partition first (so that a text which a third of all rows
   share moves once for each partition), and get the smallest id and the size of their group.

Defined results: a null text counts as empty, and empty texts equal each other; a text of white space only is one space. Of
equal texts the smallest id stays; rows that share this id and the text stay together, each counts in the size. Rows
without an id never stay beside a row with one; where no row of a group has an id, all stay. Texts of any length
are compared whole. Other columns, whatever their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, joined_by, remove, shared_folder

#: Fingerprints are numbers below this many times the rows; one row in so many is a suspect without a copy.
SPARSE = 256


def plain(text: Column) -> Column:
    """The text with each run of white space as one space; empty if it is null."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def golomb(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Ascending distinct numbers as gaps in Golomb code, whose divisor is the power of two nearest below the mean gap's 0.69.

    Gives the divisor's exponent, the quotients in unary, and the remainders.
    """
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    mean = int(values[-1]) / len(values)
    power = max(0, int(np.log2(max(1.0, 0.69 * mean))))
    quotients = (gaps >> np.uint64(power)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + len(values), np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    rest = (gaps[:, None] >> np.arange(power, dtype=np.uint64)) & np.uint64(1)
    return power, np.packbits(unary).tobytes(), np.packbits(rest.astype(np.uint8).ravel()).tobytes()


def ungolomb(n: int, power: int, unary: bytes, rest: bytes) -> np.ndarray:
    """The numbers that ``golomb`` coded."""
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(rest, np.uint8), count=n * power).reshape(n, power).astype(np.uint64)
    remainders = (bits << np.arange(power, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum((quotients.astype(np.uint64) << np.uint64(power)) + remainders, dtype=np.uint64)


def _fingerprints(marks: pa.Table, most: int) -> np.ndarray:
    return marks.column("mark").to_numpy().astype(np.int64).view(np.uint64) % np.uint64(most)


SENT = "part int, owner int, n int, power int, unary binary, rest binary"


def _sender(most: int, owners: int):
    def send(marks: pa.Table) -> pa.Table:
        values = np.unique(_fingerprints(marks, most))
        to = (values.astype(np.float64) * (owners / most)).astype(np.int64).clip(0, owners - 1)  # never falls
        cuts = np.flatnonzero(np.diff(to, prepend=-1, append=owners))
        runs = [values[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        coded = [golomb(run) for run in runs]
        part = marks.column("part")[0].as_py()
        return pa.table(
            [pa.array([part] * len(runs), pa.int32()), pa.array(to[cuts[:-1]].astype(np.int32)), pa.array([len(r) for r in runs], pa.int32()), *(pa.array([c[k] for c in coded], kind) for k, kind in enumerate((pa.int32(), pa.binary(), pa.binary())))],
            names=["part", "owner", "n", "power", "unary", "rest"],
        )

    return send


def _answer(sent: pa.Table) -> pa.Table:
    """An owner's bitmaps, one for each partition that sent a run."""
    runs = [ungolomb(r["n"], r["power"], r["unary"], r["rest"]) for r in sent.to_pylist()]
    values, back, times = np.unique(np.concatenate(runs), return_inverse=True, return_counts=True)
    again = (times > 1)[back].astype(np.uint8)
    bits, at = [], 0
    for run in runs:
        bits.append(np.packbits(again[at : at + len(run)]).tobytes())
        at += len(run)
    return pa.table([sent.column("part").cast(pa.int32()), sent.column("owner").cast(pa.int32()), sent.column("n").cast(pa.int32()), pa.array(bits, pa.binary())], names=["part", "owner", "n", "bits"])


def _marker(most: int):
    def mark(marks: pa.Table, answers: pa.Table) -> pa.Table:
        """A partition's suspects, one bit for each row."""
        _, back, times = np.unique(_fingerprints(marks, most), return_inverse=True, return_counts=True)
        got = [np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"]) for r in answers.sort_by("owner").to_pylist()]
        suspect = ((np.concatenate(got) > 0) | (times > 1))[back]
        place = marks.column("place").to_numpy()
        flags = np.zeros(-(-(int(place.max()) + 1) // 64) * 64, np.uint8)
        flags[place] = suspect
        words = np.packbits(flags, bitorder="little").view(np.int64)
        return pa.table([pa.array([marks.column("part")[0].as_py()], pa.int32()), pa.array([words.tolist()], pa.list_(pa.int64()))], names=["part", "words"])

    return mark


def exact_groups(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """Per row: id, keep_id (the id that stays), group_size, kept, text_sha256 (of the text as compared)."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()
    rows = (
        df.select(F.col(id_col).alias("id"), plain(text).alias("plain"))
        .coalesce(parts)
        .select("id", "plain", F.xxhash64("plain").alias("mark"), F.sha2("plain", 256).alias("text_sha256"), F.shiftright(place, 33).cast("int").alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    )
    name = f"fingerprints_{uuid4().hex}"
    folder = f"{shared_folder(spark)}/{name}"
    rows.write.format("parquet").option("path", folder).bucketBy(parts, "part").saveAsTable(name)
    try:
        placed = spark.table(name)
        most = max(1, SPARSE * placed.count())
        marks = placed.select("part", "place", "mark")
        sent = marks.groupBy("part").applyInArrow(_sender(most, parts), SENT)
        answers = sent.groupBy("owner").applyInArrow(_answer, "part int, owner int, n int, bits binary")
        words = durable(marks.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_marker(most), "part int, words array<long>"))

        def flagged(bit: int, *columns: str) -> DataFrame:
            own = F.expr(f"getbit(w.words[cast(t.place div 64 as int)], cast(t.place % 64 as int)) = {bit}")
            return placed.alias("t").join(words.alias("w").hint("shuffle_hash"), (F.col("t.part") == F.col("w.part")) & own).select(*(f"t.{c}" for c in columns))

        key = F.struct("text_sha256", "mark")
        groups = flagged(1, "plain", "text_sha256", "mark", "id").groupBy("plain", "text_sha256", "mark").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        groups = durable(groups.select(key.alias("key"), "keep_id", "group_size", F.col("group_size").alias("rows")))
        copies = joined_by(flagged(1, "id", "text_sha256", "mark").withColumn("key", key), groups, "key", "rows").select("id", "keep_id", "group_size", "text_sha256")
        single = flagged(0, "id", "text_sha256").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
        return durable(copies.union(single)).select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, folder)
