"""Sharding: longest-processing-time scheduling of groups that must stay together.

Groups go, largest first, to the shard with the least load. Groups of a thousandth of a shard's load or more, of which
there are a thousand for each shard at most, reach the driver one by one and pass through the heap in the order of their sizes.
All others are taken in bins, by falling size: one for each size below ``EXACT_BELOW`` bytes and ``PER_OCTAVE`` for each
doubling above it, so that the plan is bounded whatever the number of groups. The groups of one bin are alike,
so the heap's choice for them is a number of groups for each shard; which group goes where follows from its
rank by size within its bin.

Defined results: a null text counts as empty; equal texts always share a shard, also when one group holds
a third of all rows (no law of even shards can split it); repeated rows and null ids get slots of their own. Groups of
equal size go by the hash of their text, shards of equal load by number; texts of any length count whole; an empty
table gives no rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, joined_by, size_bin, with_rank

EXACT_BELOW, PER_OCTAVE = 4096, 512
#: A group of this share of a shard's mean load, or more, is dealt by itself.
LARGE = 0.001


def longest_first(bins: list[tuple[int, int, float]], shards: int) -> list[tuple[int, list[int], list[int]]]:
    """For each (bin, groups, mean size): (bin, first rank of each run, shard of each run).

    Bins are taken by falling size. What the heap would do with many alike groups is worked out at once: they
    fill the shards up to one level, and the heap deals the few that are left.
    """
    load = np.zeros(shards)
    plan = []
    for key, n, mean in sorted(bins, key=lambda x: (-x[2], x[0])):
        given = np.zeros(shards, dtype=np.int64)
        if n > 4 * shards and mean > 0:
            order = np.argsort(load, kind="stable")
            sums = np.cumsum(load[order])
            level = (sums + n * mean) / np.arange(1, shards + 1)
            k = int(np.flatnonzero(load[order] < level)[-1])
            given = np.maximum(0, np.floor((level[k] - load) / mean)).astype(np.int64)
            while given.sum() > n:
                given[np.argmax(given)] -= 1
        heap = [(load[s] + given[s] * mean, s) for s in range(shards)]
        heapq.heapify(heap)
        for _ in range(n - int(given.sum())):
            least, s = heap[0]
            given[s] += 1
            heapq.heapreplace(heap, (least + mean, s))
        load += given * mean
        used = np.flatnonzero(given)
        starts = np.concatenate([[0], np.cumsum(given[used])[:-1]]).astype(np.int64)
        plan.append((key, starts.tolist(), used.tolist()))
    return plan


def shard_rows(df: DataFrame, id_col: str, text: Column, shards: int = 24) -> DataFrame:
    """Per row: id, size (UTF-8 bytes and 8), text_crc32, shard, slot (gapless within its shard)."""
    plain = F.coalesce(text, F.lit(""))
    rows = durable(
        df.select(
            F.col(id_col).alias("id"),
            (F.octet_length(plain) + 8).cast("long").alias("size"),
            F.crc32(plain).alias("text_crc32"),
            F.unhex(F.md5(plain)).alias("group"),
        )
    )
    groups = durable(rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")))
    least = max(1, math.ceil(LARGE * (groups.agg(F.sum("bytes")).first()[0] or 0) / shards))
    large = groups.filter(F.col("bytes") >= least).orderBy(F.desc("bytes"), "group").select("group", "bytes").collect()
    binned = groups.filter(F.col("bytes") < least).select("group", "n", "bytes", size_bin(F.col("bytes"), EXACT_BELOW, PER_OCTAVE).alias("bin"), (-F.col("bytes")).alias("fall"))
    ranked = with_rank(binned, "bin", ["fall", "group"], "rank")
    bins = [tuple(r) for r in ranked.groupBy("bin").agg(F.count(F.lit(1)), F.avg("bytes")).collect()]
    first = [(-1 - k, 1, r["bytes"]) for k, r in enumerate(large)]
    plan = longest_first(first + bins, shards)
    own = df.sparkSession.createDataFrame([(bytearray(large[-1 - key]["group"]), to[0]) for key, _, to in plan if key < 0], "group binary, shard int")
    runs = df.sparkSession.createDataFrame([p for p in plan if p[0] >= 0], "bin long, starts array<long>, shards array<int>")
    small = ranked.join(F.broadcast(runs), "bin").select("group", "n", F.expr("element_at(shards, size(filter(starts, x -> x <= rank)))").alias("shard"))
    placed = groups.select("group", "n").join(F.broadcast(own), "group").unionByName(small)
    return with_rank(durable(joined_by(rows, placed, "group", "n").drop("group")), "shard", ["id"], "slot").select("id", "size", "text_crc32", "shard", "slot")
