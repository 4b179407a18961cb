"""Language identification: prediction by partial matching.

Each language has a variable-order context tree over bytes, of contexts up to three bytes long, learned
once and then frozen. A text's code length under a language is the sum over its bytes: the longest context
that the language knows codes the byte with n / (total + distinct), or pays the escape probability
distinct / (total + distinct) and leaves the byte to the next shorter context, down to the uniform 1/256.
The language with the shortest code wins; the score is its posterior among all, at equal priors.

The trees hold bytes in tables that are looked up for all positions of a batch at once. Learning reads about
``docs_per_lang`` whole documents of each language, chosen by a hash of their ids; all that these hold is counted and
kept, each language for itself. The number of languages has a bound, beyond which learning refuses (``MOST_LANGS``), so
what reaches the driver and the tasks is bounded too: the sum of the languages' trees, and in a task ``TABLE_BYTES`` of tables.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is every text when
nothing could be learned, as from an empty table. Equal code lengths go to the first name in order. Texts are read whole,
however long; equal texts get equal results, so rows that repeat do.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, shared

ORDER = 3
MOST_LANGS = 500
#: Laid-out code lengths that a task keeps at a time, those of one language at least. Their number changes no result.
TABLE_BYTES = 1 << 28
#: Largest table of steps that is laid out in full; a larger one is searched.
FULL_TABLE = 1 << 25
#: Code lengths are kept in whole units of 1/1024 bit, so that their sums don't depend on how texts are batched.
UNITS = 1024
#: Stands before each text, so that its first bytes have whole contexts; never coded itself.
PAD = "\n" * ORDER


def padded(text: Column) -> Column:
    return F.concat(F.lit(PAD), F.coalesce(text, F.lit(""))).cast("binary")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, k, gram, n): how often each run of k bytes ends in a coded byte."""
    for batch in batches:
        langs = np.asarray(batch.column(0).to_pylist(), dtype=object)
        for a, b, data, offsets in byte_slices(batch, "data"):
            names, which = np.unique(langs[a:b].astype(str), return_inverse=True)
            owner = np.repeat(which.astype(np.uint64), np.diff(offsets))
            coded = np.ones(len(data), bool)
            for i in range(ORDER):
                coded[offsets[:-1] + i] = False
            at = np.flatnonzero(coded)
            gram = np.zeros(len(at), np.uint64)
            for k in range(1, ORDER + 2):
                gram |= data[at - (k - 1)].astype(np.uint64) << np.uint64(8 * (k - 1))
                found, n = np.unique(owner[at] << np.uint64(32) | gram, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[(found >> np.uint64(32)).astype(int)].tolist(), pa.string()), pa.array(np.full(len(found), k, np.int32)), pa.array((found & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n.astype(np.int64))],
                    names=["lang", "k", "gram", "n"],
                )


class Steps:
    """The number, from 1, of each place in a list; 0 for all others below ``size``."""

    def __init__(self, places: np.ndarray, size: int):
        self.full = size <= FULL_TABLE
        if self.full:
            self.table = np.zeros(size, np.int32)
            self.table[places] = np.arange(1, len(places) + 1)
        else:
            self.order = np.argsort(places)
            self.places = places[self.order]

    def find(self, at: np.ndarray) -> np.ndarray:
        if self.full:
            return self.table[at]
        near = np.minimum(np.searchsorted(self.places, at), len(self.places) - 1)
        return np.where(self.places[near] == at, self.order[near] + 1, 0).astype(np.int32)


class Trees:
    """The frozen context trees of all languages: each language's own counts, and the runs of bytes of all of them.

    What is sent to the tasks grows with the sum of the languages' trees. Code lengths by run are laid out for one
    language at a time (:meth:`tables`).
    """

    def __init__(self, lang: np.ndarray, k: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.langs = sorted(set(lang.tolist()))
        index = {x: i for i, x in enumerate(self.langs)}
        which = np.array([index[x] for x in lang.tolist()], dtype=np.int64)
        own = {o: (gram[k == o], which[k == o], n[k == o]) for o in range(1, ORDER + 2)}
        # Every gram kept has its context (without the last byte) and its rest (without the first) beside it.
        grams = {ORDER + 1: np.unique(own[ORDER + 1][0])}
        for o in range(ORDER, 0, -1):
            up, mask = grams[o + 1], (1 << 8 * o) - 1
            grams[o] = np.unique(np.concatenate([own[o][0], up >> 8, up & mask]))
        self.symbol = np.zeros(256, np.int32)
        self.symbol[grams[1]] = np.arange(1, len(grams[1]) + 1)
        self.width = len(grams[1]) + 1
        self.step: dict[int, Steps] = {}
        self.context: dict[int, np.ndarray] = {}
        self.rest: dict[int, np.ndarray] = {}
        self.own: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for o in range(1, ORDER + 2):
            g = grams[o]
            self.context[o] = (np.searchsorted(grams[o - 1], g >> 8) + 1 if o > 1 else np.zeros(len(g))).astype(np.int32)
            self.rest[o] = (np.searchsorted(grams[o - 1], g & ((1 << 8 * (o - 1)) - 1)) + 1 if o > 1 else np.zeros(len(g))).astype(np.int32)
            found, whose, count = own[o]
            order = np.argsort(whose, kind="stable")
            ends = np.searchsorted(whose[order], np.arange(1, len(self.langs)))
            self.own[o] = list(zip(np.split((np.searchsorted(g, found) + 1).astype(np.int32)[order], ends), np.split(count[order], ends), strict=True))
            if o > 1:
                self.step[o] = Steps(self.context[o].astype(np.int64) * self.width + self.symbol[g & 255], (len(grams[o - 1]) + 1) * self.width)
        self.made: OrderedDict[int, tuple[dict[int, np.ndarray], dict[int, np.ndarray]]] = OrderedDict()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"made": OrderedDict()}

    def tables(self, m: int) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
        """(cost, escape) by order and run in one language; the latest that fit ``TABLE_BYTES`` are kept, the others made again."""
        if m in self.made:
            self.made.move_to_end(m)
            return self.made[m]
        cost: dict[int, np.ndarray] = {}
        escapes: dict[int, np.ndarray] = {}
        for o in range(1, ORDER + 2):
            context, (ids, n) = self.context[o], self.own[o][m]
            contexts = len(self.context[o - 1]) + 1 if o > 1 else 1
            count = np.zeros(len(context))
            count[ids - 1] = n
            total, distinct = np.bincount(context, count, contexts), np.bincount(context, count > 0, contexts)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
                direct = -np.log2(count / (total + distinct)[context])
            shorter = cost[o - 1][self.rest[o]] / UNITS if o > 1 else 8.0
            # A byte that no language has costs the escape and the uniform code.
            first = escape[0] + 8.0 if o == 1 else 0.0
            cost[o] = np.rint(np.concatenate([[first], np.where(count > 0, direct, escape[context] + shorter)]) * UNITS).astype(np.int32)
            escapes[o - 1] = np.rint(escape * UNITS).astype(np.int32)
        self.made[m] = cost, escapes
        each = sum(x.nbytes for t in self.made[m] for x in t.values())
        while len(self.made) > max(1, TABLE_BYTES // each):
            self.made.popitem(last=False)
        return cost, escapes

    def lengths(self, data: np.ndarray, offsets: np.ndarray, window: int = 1 << 19) -> np.ndarray:
        """Code length of each padded text in each language."""
        sums = np.zeros((len(self.langs), len(offsets) - 1), np.int64)
        for lo in range(0, len(data), window):
            back = min(lo, ORDER)
            s = self.symbol[data[lo - back : lo + window]]
            ids = {1: s}
            for o in range(2, ORDER + 2):
                ids[o] = np.zeros(len(s), np.int32)
                ids[o][1:] = self.step[o].find(ids[o - 1][:-1].astype(np.int64) * self.width + s[1:])
            first, last = np.searchsorted(offsets, [lo, lo + len(s) - back - 1], side="right") - 1
            starts = np.maximum(offsets[first : last + 1] - lo, 0) + back
            coded = np.ones(len(s), bool)
            coded[:back] = False
            for i in range(ORDER):
                head = offsets[first : last + 1] - lo + back + i
                coded[head[(head >= 0) & (head < len(s))]] = False
            ids[ORDER + 1][~coded] = 0
            missing = np.flatnonzero(coded & (ids[ORDER + 1] == 0))
            owner = np.searchsorted(starts, missing, side="right") - 1
            for m in range(len(self.langs)):
                cost, escape = self.tables(m)
                part = np.add.reduceat(cost[ORDER + 1][ids[ORDER + 1]], starts, dtype=np.int64)
                if len(missing):
                    part += np.bincount(owner, self._shorter(cost, escape, ids, missing, ORDER), len(starts)).astype(np.int64)
                sums[m, first : last + 1] += part
        return sums

    def _shorter(self, cost: dict[int, np.ndarray], escape: dict[int, np.ndarray], ids: dict[int, np.ndarray], at: np.ndarray, order: int) -> np.ndarray:
        """Cost of bytes whose context of ``order`` bytes doesn't have them: its escape, then the shorter context."""
        found = escape[order][ids[order][at - 1]].astype(np.int64)
        here = ids[order][at]
        found += cost[order][here]
        if order > 1:
            out = np.flatnonzero(here == 0)
            found[out] += self._shorter(cost, escape, ids, at[out], order - 1)
        return found


def learn(df: DataFrame, id_col: str, lang_col: str, text: Column, docs_per_lang: int = 1000) -> Trees | None:
    """The trees of all languages named in ``df``, from about ``docs_per_lang`` documents of each."""
    rows = df.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), text.alias("text")).filter("lang is not null and text is not null")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.count(F.lit(1))).limit(MOST_LANGS + 1).collect()}
    if not sizes:
        return None
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"{len(sizes)} languages, {MOST_LANGS} at most")
    share = F.create_map(*(F.lit(x) for s, n in sizes.items() for x in (s, min(1.0, docs_per_lang / n))))
    place = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
    counts = rows.filter(place < share[F.col("lang")]).select("lang", padded(F.col("text")).alias("data")).mapInArrow(_count, "lang string, k int, gram long, n long")
    top = counts.groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")).toArrow()
    if not top.num_rows:
        return None
    return Trees(np.asarray(top["lang"].to_pylist(), dtype=object), *(top[c].to_numpy() for c in ("k", "gram", "n")))


def predict(df: DataFrame, id_col: str, text: Column, trees: Trees | None) -> DataFrame:
    """Per row: id, lang, score and the winner's bits for each byte."""
    known = text.isNotNull() & text.rlike(r"\p{L}")
    picked = df.select(F.col(id_col).alias("id"), F.coalesce(known, F.lit(False)).alias("known"), padded(text).alias("data"))
    out = f"id {picked.schema['id'].dataType.simpleString()}, lang string, score double, bits double"
    if trees is None:
        return picked.select("id", F.lit("und").alias("lang"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits"))
    frozen = shared(df.sparkSession, trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = frozen()
        names = np.array(model.langs, dtype=object)
        for batch in batches:
            known = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in byte_slices(batch, "data"):
                sums = model.lengths(data, offsets) / UNITS
                best = np.argmin(sums, axis=0)
                least = sums[best, np.arange(b - a)]
                score = 1.0 / np.exp2(np.maximum(least - sums, -1000.0)).sum(axis=0)
                bits = least / np.maximum(1, np.diff(offsets) - ORDER)
                lang = np.where(known[a:b], names[best], "und")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(lang, pa.string()), pa.array(np.where(known[a:b], score, 0.0)), pa.array(bits)], names=["id", "lang", "score", "bits"]
                )

    return picked.mapInArrow(run, out)
