"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams of 3 to 6 characters of the text, with A-Z lower-cased and each white-space character of
ASCII as a space, present or absent in a document; they are told apart by 64-bit hashes. From labelled documents, each
n-gram has the ratio r = log((p + a) / |p|) - log((q + a) / |q|) of its smoothed document counts in both classes. All
n-grams whose counts differ between the classes with significance (likelihood-ratio statistic of ``SIGNIFICANT`` at
least) are kept, each scaled by its r, and Spark ML fits a regularised logistic regression over them.

Learning reads at most ``docs_per_class`` whole labelled documents of each class, chosen by a hash of their
ids; the intercept is then moved to the classes' true shares. Scoring reads every text whole.

Defined results: null texts count as empty; an empty text gets the score of a document without features.
Without labels the score is 0, with one class only it is that class. Equal texts have equal scores, so rows that repeat
do; very long texts are read whole, in windows; an empty table gives no rows. A score of exactly 0.5 counts as toxic.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, durable, shared

SIZES = (3, 4, 5, 6)
#: Which positions can hold a feature is asked of a bitmap first; it has 2 to this power places.
SIEVE = 22
#: Bytes of text that a task looks at together, longer texts apart; some twenty times as many are held.
SLICE = 1 << 20
#: Chi-squared with one degree of freedom exceeds this by chance once in a thousand times.
SIGNIFICANT = 10.83
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x9FB21C651E98DF25)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of rows of UTF-8, lower-cased, and the rows' offsets in them."""
    starts = (data & 0xC0) != 0x80
    lengths = [np.count_nonzero(starts[a:b]) for a, b in pairwise(offsets)]
    text = _LOWER[data].tobytes().decode("utf-8", "replace")
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def grams(points: np.ndarray, size: int) -> np.ndarray:
    """A hash of each position's n-gram, from there on."""
    n = max(0, len(points) - size + 1)
    code = np.full(n, size, np.uint64)
    for i in range(size):
        code = (code ^ points[i : i + n]) * _BASE
        code ^= code >> np.uint64(29)
    return code


def owners(offsets: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The row of each position, and whether the n-gram ends inside the row."""
    row = np.searchsorted(offsets, at, side="right") - 1
    return row, at + size <= offsets[row + 1]


def plain(text: Column) -> Column:
    """Space before and after, so that n-grams see where words begin and end."""
    return F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")).cast("binary")


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n0, n1): documents of each class that have the n-gram."""
    for batch in batches:
        labels = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b, data, offsets in byte_slices(batch, "data", SLICE):
            points, ends = characters(data, offsets)
            for size in SIZES:
                parts = [np.unique(grams(points[ends[i] : ends[i + 1]], size)) for i in range(b - a)]
                code = np.concatenate(parts)
                label = np.repeat(labels[a:b], [len(x) for x in parts])
                found, back = np.unique(code, return_inverse=True)
                both = [pa.array(np.bincount(back, label == k, len(found)).astype(np.int64)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), *both], names=["gram", "n0", "n1"])


class Lexicon:
    """The kept n-grams in order, and a bitmap that tells most others apart at once."""

    def __init__(self, grams: np.ndarray):
        self.grams = grams
        self.sieve = np.zeros(1 << SIEVE, bool)
        self.sieve[(grams * _MIX) >> np.uint64(64 - SIEVE)] = True

    def find(self, data: np.ndarray, offsets: np.ndarray, window: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature) of all features present, each once for a row; what is held at once is bounded by the window, but for the code points."""
        points, ends = characters(data, offsets)
        found = [np.zeros(0, np.int64)]
        for lo in range(0, len(points), window):
            part = points[lo : lo + window + max(SIZES) - 1]
            for size in SIZES:
                code = grams(part, size)[:window]
                at = np.flatnonzero(self.sieve[(code * _MIX) >> np.uint64(64 - SIEVE)])
                place = np.minimum(np.searchsorted(self.grams, code[at]), len(self.grams) - 1)
                real = self.grams[place] == code[at]
                row, inside = owners(ends, at[real] + lo, size)
                found.append(np.unique(row[inside] * len(self.grams) + place[real][inside]))
        both = np.unique(np.concatenate(found))
        return both // len(self.grams), both % len(self.grams)


class Classifier:
    """``weights`` already hold the ratios; ``bias`` holds the true shares of the classes."""

    def __init__(self, lexicon: Lexicon | None, weights: np.ndarray, bias: float):
        self.lexicon, self.weights, self.bias = lexicon, weights, bias


def learn(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, text: Column, docs_per_class: int = 2000, smooth: float = 1.0, ridge: float = 1e-4) -> Classifier:
    """From the texts of ``docs`` and the 0 and 1 labels of ``labels``, which share ``id_col``.

    The sample is chosen among the labels alone, so only its texts are read into the join; it is broadcast,
    at most ``docs_per_class`` ids of each class.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1) and id is not null")
    sizes = {r[0]: r[1] for r in marks.groupBy("label").agg(F.count(F.lit(1))).collect()}
    if len(sizes) < 2:
        return Classifier(None, np.zeros(0), {0: -math.inf, 1: math.inf}[next(iter(sizes), 0)])
    chosen = [marks.filter(F.col("label") == k).orderBy(F.xxhash64("id", F.lit(2)), "id").limit(docs_per_class) for k in (0, 1)]
    texts = docs.select(F.col(id_col).alias("id"), plain(text).alias("data"))
    sample = durable(texts.join(F.broadcast(chosen[0].union(chosen[1])), "id").select("label", "data"))
    taken = {r[0]: r[1] for r in sample.groupBy("label").agg(F.count(F.lit(1))).collect()}
    if len(taken) < 2:
        return Classifier(None, np.zeros(0), math.log(sizes[1] / sizes[0]))
    counts = sample.mapInArrow(_document_counts, "gram long, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    total = sum(taken.values())

    def term(n: Column, docs: int) -> Column:
        expected = (F.col("n0") + F.col("n1")) * (docs / total)
        return F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)

    tells = 2 * (term(F.col("n0"), taken[0]) + term(F.col("n1"), taken[1]))
    top = counts.filter(tells >= SIGNIFICANT).toArrow()
    code = top["gram"].to_numpy().view(np.uint64)
    order = np.argsort(code)
    p, q = ((top[c].to_numpy()[order] + smooth) / (taken[k] + 2 * smooth) for c, k in (("n1", 1), ("n0", 0)))
    ratio = np.log(p / q)
    if not len(code):
        return Classifier(None, np.zeros(0), math.log(sizes[1] / sizes[0]))
    lexicon = Lexicon(code[order])
    kept = shared(docs.sparkSession, lexicon)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept()
        for batch in batches:
            for a, b, data, offsets in byte_slices(batch, "data", SLICE):
                row, feature = known.find(data, offsets)
                ends = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.float64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(feature.astype(np.int32)))], names=["label", "present"])

    @F.udf(VectorUDT())  # Arrow has no type for Spark ML's vectors; these are the sample's rows only
    def vector(present):
        return Vectors.sparse(len(ratio), present, ratio[present])

    data = durable(sample.mapInArrow(present, "label double, present array<int>").withColumn("features", vector("present")).coalesce(8).select("label", "features"))
    # The ratios are the scale that counts, so features are not standardised again.
    fitted = LogisticRegression(maxIter=60, regParam=ridge, standardization=False, tol=1e-7).fit(data)
    shift = math.log(sizes[1] / sizes[0]) - math.log(taken[1] / taken[0])
    return Classifier(lexicon, fitted.coefficients.toArray() * ratio, fitted.intercept + shift)


def score(df: DataFrame, id_col: str, text: Column, classifier: Classifier) -> DataFrame:
    """Per row: id and score, the probability of label 1."""
    picked = df.select(F.col(id_col).alias("id"), plain(text).alias("data"))
    if classifier.lexicon is None:
        return picked.select("id", F.lit(1.0 / (1.0 + math.exp(min(700.0, max(-745.0, -classifier.bias))))).alias("score"))
    fitted = shared(df.sparkSession, classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fitted()
        for batch in batches:
            for a, b, data, offsets in byte_slices(batch, "data", SLICE):
                row, feature = model.lexicon.find(data, offsets)
                margin = np.bincount(row, model.weights[feature], b - a) + model.bias
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(1.0 / (1.0 + np.exp(-np.clip(margin, -700, 700))))], names=["id", "score"])

    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, score double")
