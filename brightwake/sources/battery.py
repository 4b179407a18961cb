"""Frames of a battery monitor: put together from the chunks in which they arrive, checked, and read.

A frame begins with a chunk whose first two bytes name its kind and goes on over the chunks that follow, until the next beginning; its last
byte is the CRC-8 of the others. A chunk that comes too late after the one before it belongs to nothing, and frames that are too
short or whose checksum is wrong are dropped. Devices are split into buckets of time, so that one device's chunks need no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightwake.operators import split

# The first two bytes of each kind of frame, and its least length without the checksum.
KINDS = {"ccf0": ("status", 18), "ccf1": ("name", 10), "ccf2": ("temperature", 9), "ccf3": ("maker", 12), "ccf4": ("cells", 18), "ccf5": ("protection", 5)}
#: Fixed value: the checksum's polynomial, its bits reversed.
POLYNOMIAL = 0x8C


def crc_table(polynomial: int = POLYNOMIAL) -> list[int]:
    """What each byte does to the checksum."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = (value >> 1) ^ polynomial if value & 1 else value >> 1
        table.append(value)
    return table


def octets(frame: Column) -> Column:
    """A binary's bytes as numbers."""
    pairs = F.regexp_extract_all(F.hex(frame), F.lit("(..)"), 1)
    return F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int"))


def crc8(values: Column) -> Column:
    """Folds the bytes, an array of numbers, through the table."""
    table = F.lit(crc_table())
    return F.aggregate(values, F.lit(0), lambda acc, b: F.get(table, acc.bitwiseXOR(b)))


def number(values: Column, at: int, size: int, signed: bool = False, big: bool = False) -> Column:
    parts = [F.get(values, F.lit(at + k)) * (1 << 8 * ((size - 1 - k) if big else k)) for k in range(size)]
    total = sum(parts[1:], parts[0])
    return F.when(total >= 1 << (8 * size - 1), total - (1 << 8 * size)).otherwise(total) if signed else total


def frames(chunks: DataFrame, device: str = "device", time: str = "time", seq: str = "seq", data: str = "data", within: float = 2.0, bucket: str = "1 hour") -> DataFrame:
    """(device, time, kind, bytes) of whole frames; ``seq`` orders chunks of one instant. Null and empty chunks don't count."""
    rows = chunks.filter(F.length(data) > 0).select(F.col(device).alias("device"), F.col(time).alias("time"), F.col(seq).alias("seq"), F.col(data).alias("data"))
    head = F.lower(F.hex(F.substring("data", 1, 2)))
    rows = split.neighbours(rows.withColumn("begins", head.isin(*KINDS).cast("int")), ["device"], ["time"], False, "time", ("seq",), bucket)
    late = F.coalesce(F.unix_micros("time") - F.unix_micros("time_before") > int(within * 1e6), F.lit(False))
    rows = rows.withColumn("breaks", F.when((F.col("begins") == 1) | late, 1).otherwise(0))
    rows = split.running(rows, ["device"], "breaks", "sum", "run", True, "time", ("seq",), bucket)
    whole = rows.groupBy("device", "run").agg(F.min("time").alias("time"), F.array_sort(F.collect_list(F.struct("time", "seq", "data", "begins"))).alias("parts"))
    # Each frame is read once: what is found passes through an array of one, into which no filter is pushed and from which none is worked out again.
    digits = F.array_join(F.transform("parts", lambda p: F.hex(p["data"])), "")
    once = whole.filter(F.get("parts", F.lit(0))["begins"] == 1).select("device", "time", F.explode(F.array(F.unhex(digits))).alias("frame"))
    read = once.select("device", "time", F.explode(F.array(F.struct("frame", octets(F.col("frame")).alias("all"), F.lower(F.hex(F.substring("frame", 1, 2))).alias("head")))).alias("f")).select("device", "time", "f.*")
    kinds, least = (F.create_map(*(F.lit(x) for k, kind in KINDS.items() for x in (k, kind[i]))) for i in (0, 1))
    size = F.size("all") - 1
    good = (size >= F.element_at(least, F.col("head"))) & (crc8(F.slice("all", F.lit(1), F.greatest(size, F.lit(0)))) == F.element_at("all", -1))
    return read.filter(good).select("device", "time", F.element_at(kinds, F.col("head")).alias("kind"), "frame", F.slice("all", F.lit(1), size).alias("bytes"))


def readings(found: DataFrame) -> DataFrame:
    """Each frame with its readings; those of other kinds are null."""
    b, of = F.col("bytes"), lambda kind, value: F.when(F.col("kind") == kind, value)
    # Index, volts and a spare byte for each of four cells.
    cells = F.array(*(F.struct(number(b, 2 + 4 * x, 1).alias("cell"), number(b, 3 + 4 * x, 2).alias("mv")) for x in range(4)))
    volts = [number(b, 3 + 4 * x, 2) for x in range(4)]
    return found.select(
        "device", "time", "kind",
        of("status", number(b, 2, 3, True) / 1000).alias("voltage_v"), of("status", number(b, 5, 3, True) / 1_000_000).alias("current_a"), of("status", number(b, 8, 3, True)).alias("power_w"), of("status", number(b, 11, 3, True) / 1_000_000).alias("mean_current_a"),
        of("status", number(b, 14, 2)).alias("cycles"), of("status", number(b, 16, 2)).alias("soc_pct"), of("name", F.regexp_replace(F.decode(F.substring("frame", 3, 8), "UTF-8"), "[\\x00 ]+$", "")).alias("name"),
        of("temperature", number(b, 5, 2, True)).alias("temp_bms_c"), of("temperature", number(b, 7, 2, True)).alias("temp_mos_c"), of("maker", number(b, 2, 1) + 2000).alias("year_mfg"), of("maker", number(b, 5, 3, big=True) / 128).alias("capacity_ah"),
        of("maker", number(b, 8, 2) == 1).alias("heater"), of("maker", number(b, 10, 2) / 100).alias("nominal_v"), of("cells", cells).alias("cells"), of("cells", sum(volts[1:], volts[0]) / 1000).alias("cells_v"), of("cells", F.greatest(*volts) - F.least(*volts)).alias("cell_imbalance_mv"),
        of("protection", number(b, 2, 1)).alias("prot_flags"), of("protection", number(b, 3, 1) == 1).alias("prot_cmos"), of("protection", number(b, 4, 1) == 1).alias("prot_dmos"),
    )
