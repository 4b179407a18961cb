"""Mixing sources to target weights: Pfair scheduling.

A source's rows are cut into blocks. With weight w, block k of a source is released at floor(k / w) and
due at ceil((k + 1) / w); taking, in each slot, the released block with the earliest deadline meets all
deadlines, so that after any number of slots each source is less than one block from its share.

The weights are taken exactly, as the decimal numbers that they print as, over the whole of a phase. When a
source has given its last block, a new phase begins with the weights of the others scaled up; the bound
holds within each phase. All rows are placed, none twice. Weights whose schedule repeats within a frame, such as those of
``targets``, are worked out once for each phase, and Spark spreads the plan's few rows over the blocks. With other weights, which a caller
may give, each block follows from all before it, so the driver deals them one after another, from the sources' sizes alone, with a step for
each block of rows (its time grows with them), holds ``PIECE`` rows of the plan at a time, and writes them to the shared folder, from
which they go once they are checkpointed. There may be ``MOST_SOURCES`` sources; mixing refuses more.

Defined results: null sources are one source, the empty name; an empty table gives an empty mix; rows
that repeat stay, each with a place of its own; rows of a source that tie in their ids come in any order, null ids first.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from fractions import Fraction
from itertools import batched, chain, count, islice
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, fresh, joined_by, quoted, remove, shared_folder, with_rank

FRAME = 1024
#: Rows of the plan that the driver holds at a time, and blocks of a source that a row of the plan is spread into at a time.
PIECE = 16_384
MOST_SOURCES = 10_000
PLAN = "source string, from_block long, to_block long, start long, frame long, slots array<int>"


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportions of the weights."""
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * scale) for s, w in exact.items()}


def earliest_deadline(weights: dict[str, int]) -> Iterator[str]:
    """The source of each slot, without end."""
    total = sum(weights.values())
    waiting = [(0, -(-total // w), s, 0) for s, w in sorted(weights.items())]  # release, deadline, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    for now in count():
        while waiting and waiting[0][0] <= now:
            _, due, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, k))
        due, s, k = heapq.heappop(ready)
        if now >= due:
            raise AssertionError("a deadline was missed")
        yield s
        heapq.heappush(waiting, ((k + 1) * total // weights[s], -(-(k + 2) * total // weights[s]), s, k + 1))


def until_one_ends(turns: Iterator[str], left: dict[str, int]) -> Iterator[str]:
    """The turns up to the last block of any source."""
    left = dict(left)
    for s in turns:
        yield s
        left[s] -= 1
        if not left[s]:
            return


def places(turns: Iterable[str]) -> dict[str, list[int]]:
    placed: dict[str, list[int]] = {}
    for at, s in enumerate(turns):
        placed.setdefault(s, []).append(at)
    return dict(sorted(placed.items()))


def deal(blocks: dict[str, int], weights: dict[str, float], frame: int = FRAME) -> Iterator[tuple[str, int, int, int, int, list[int]]]:
    """(source, first block, block after the last, first slot, period, slots in the period).

    Where the weights of those that still have blocks repeat within ``frame`` slots, one row for each source tells all up to the end of
    the first that runs out, however many blocks that are; else each row has at most ``frame`` blocks.
    """
    done = dict.fromkeys(blocks, 0)
    exact = whole_weights(weights)
    start = 0
    while active := {s: exact[s] for s in blocks if done[s] < blocks[s]}:
        shrink = math.gcd(*active.values())
        active = {s: w // shrink for s, w in active.items()}
        left = {s: blocks[s] - done[s] for s in active}
        period = sum(active.values())
        if period <= frame:
            cycle = places(islice(earliest_deadline(active), period))
            end = min((left[s] - 1) // len(at) * period + at[(left[s] - 1) % len(at)] for s, at in cycle.items()) + 1
            pieces: Iterable = [(end, cycle)]
        else:
            pieces = ((len(part), places(part)) for part in batched(until_one_ends(earliest_deadline(active), left), frame))
        for length, placed in pieces:
            period = sum(map(len, placed.values()))
            for s, at in placed.items():
                given = length // period * len(at) + bisect_left(at, length % period)
                if given:
                    yield s, done[s], done[s] + given, start, period, at
                done[s] += given
            start += length


def schedule(blocks: dict[str, int], weights: dict[str, float], frame: int = FRAME) -> list[tuple[str, int, int, int, int, list[int]]]:
    """All that ``deal`` gives."""
    return list(deal(blocks, weights, frame))


def targets(sizes: dict[str, int], frame: int = FRAME) -> dict[str, float]:
    """Whole weights in the proportions of the sizes' square roots, one at least, of about ``frame`` in all (of eight a source, if that is more)."""
    roots = {s: math.sqrt(n) for s, n in sizes.items()}
    total, shares = sum(roots.values()), max(frame, 8 * len(sizes)) - len(sizes)
    return {s: max(1, round(shares * r / total)) for s, r in roots.items()}


def _plan(spark: SparkSession, rows: Iterator[tuple]) -> DataFrame:
    """The rows as a table; where there are many of them, they go by pieces into the shared folder."""
    first = list(islice(rows, PIECE))
    if len(first) < PIECE:
        return spark.createDataFrame(first, PLAN)
    folder = f"{shared_folder(spark)}/mix-{uuid4().hex}"
    for piece in chain([first], batched(rows, PIECE)):
        spark.createDataFrame(list(piece), PLAN).coalesce(1).write.mode("append").parquet(folder)
    plan = durable(spark.read.schema(PLAN).parquet(folder))
    remove(spark, folder)
    return plan


def mix(df: DataFrame, id_col: str, source_col: str, weights: dict[str, float] | None = None, block_rows: int = 16, frame: int = FRAME, carry: dict[str, Column] | None = None) -> DataFrame:
    """Per row: id, source, block, slot (its block's) and position, by which the mix is ordered.

    Without ``weights`` a source's target is the square root of its number of rows, as a whole share of ``frame`` (``targets``), so that
    what the driver does grows with the sources only. ``carry`` names further columns that go along with each row.
    """
    along = carry or {}
    rows = durable(df.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), *(c.alias(name) for name, c in along.items())))
    sizes = {r[0]: r[1] for r in rows.groupBy("source").agg(F.count(F.lit(1))).limit(MOST_SOURCES + 1).collect()}
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    if weights is None:
        weights = targets(sizes, frame)
        frame = max(frame, int(sum(weights.values())))
    if missing := [s for s in sizes if weights.get(s, 0) <= 0]:
        raise ValueError(f"no positive weight for {missing[:5]}")
    plans = _plan(df.sparkSession, deal({s: -(-n // block_rows) for s, n in sizes.items()}, weights, frame))
    plans = plans.withColumn("piece", F.explode(F.expr(f"sequence(0L, (to_block - from_block - 1) div {PIECE})")))
    plans = plans.withColumn("at", F.explode(F.expr(f"sequence(piece * {PIECE}, least((piece + 1) * {PIECE}, to_block - from_block) - 1)")))
    slot = F.expr("start + at div size(slots) * frame + get(slots, cast(at % size(slots) as int))")
    plans = plans.select("source", (F.col("from_block") + F.col("at")).alias("block"), slot.alias("slot"))
    ranked = with_rank(rows, "source", ["id"], "rank").withColumn("block", F.expr(f"rank div {int(block_rows)}"))
    return ranked.join(plans, ["source", "block"]).select("id", "source", "block", "slot", (F.col("slot") * block_rows + F.col("rank") % block_rows).alias("position"), *along)


def mixed(df: DataFrame, id_col: str, source_col: str, weights: dict[str, float] | None = None, block_rows: int = 16, frame: int = FRAME) -> DataFrame:
    """The rows of ``df`` themselves, whole, dealt and sorted by their positions in the mix.

    Rows that share an id, however many, follow each other from the place of the first of them; so do rows without one.
    """
    key, position, count = fresh(df, "key", "position", "count")
    named = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    placed = mix(df, id_col, source_col, weights, block_rows, frame)
    placed = durable(placed.groupBy(named(F.col("id")).alias(key)).agg(F.min("position").alias(position), F.count(F.lit(1)).alias(count)))
    joined = joined_by(df.withColumn(key, named(F.col(quoted(id_col)))), placed, key, count)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return joined.repartitionByRange(parts, position).sortWithinPartitions(position).select(*(F.col(quoted(c)) for c in df.columns))
