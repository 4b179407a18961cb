"""Vector code compression: product quantisation with a kd-tree for each codebook.

Each component becomes the integer floor(256 x); a vector is cut into 16 equal consecutive parts, and each part position
has a codebook of 64 entries, at first those of the 64 smallest ids. In each round the driver builds one kd-tree for each
codebook and broadcasts them all (16 x 64 entries, whatever the input). Tasks find every part's nearest entry by
branch and bound: a subtree is left out only if its bound is greater than the best distance so far, so that of
entries at equal distance the lowest index is always seen. Each task adds up integers by entry and sends 16 x 64 sums; Spark
adds those, and the driver, which gets 16 x 64 rows, sets the new entries. The vectors stay where they are.

Defined results: null vectors and those with a null, infinite or NaN component are dropped. So are components beyond
``LARGEST`` (squared distances of theirs do not fit a long), and vectors whose length isn't that of the vector
with the smallest id, or isn't a multiple of the number of parts. Rows that repeat are coded each; ids that tie start in
the order of their vectors; a vector without an id is coded, but starts no entry. With fewer than 64 vectors there
are as many entries as vectors. Null labels are one label. Other columns, whatever their names, are not read. An empty
table gives no rows, and its codebooks are empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, joined_by, shared

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Greatest absolute value of a component: 64 squared differences of such components fit a long.
LARGEST = float(1 << 19)
_LEAF = 4


@dataclass
class Tree:
    """A kd-tree over a codebook's entries; leaves list their entries in ascending order."""

    entries: np.ndarray
    #: (axis, largest coordinate on the left, smallest on the right, left node, right node), or the entries of a leaf.
    nodes: list[tuple | np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        self._grow(np.arange(len(self.entries)))

    def _grow(self, members: np.ndarray) -> int:
        at = len(self.nodes)
        points = self.entries[members]
        spread = points.max(axis=0) - points.min(axis=0) if len(members) else np.zeros(1)
        if len(members) <= _LEAF or not spread.any():
            self.nodes.append(np.sort(members))
            return at
        self.nodes.append(())
        axis = int(np.argmax(spread))
        ranked = members[np.argsort(points[:, axis], kind="stable")]
        half = len(ranked) // 2
        left, right = ranked[:half], ranked[half:]
        bounds = int(self.entries[left, axis].max()), int(self.entries[right, axis].min())
        self.nodes[at] = (axis, *bounds, self._grow(left), self._grow(right))
        return at

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of each point's nearest entry, the lowest of those that tie, and the squared distance."""
        index = np.full(len(points), len(self.entries), np.int64)
        best = np.full(len(points), np.iinfo(np.int64).max, np.int64)

        def visit(node: int, rows: np.ndarray) -> None:
            if not len(rows):
                return
            found = self.nodes[node]
            if isinstance(found, np.ndarray):
                apart = points[rows][:, None, :] - self.entries[found][None, :, :]
                apart = (apart * apart).sum(axis=2)
                first = np.argmin(apart, axis=1)  # the first of equal ones, hence the lowest index of the leaf
                near, which = apart[np.arange(len(rows)), first], found[first]
                better = (near < best[rows]) | ((near == best[rows]) & (which < index[rows]))
                best[rows[better]], index[rows[better]] = near[better], which[better]
                return
            axis, left_most, right_least, left, right = found
            x = points[rows, axis]
            to_left, to_right = np.maximum(x - left_most, 0) ** 2, np.maximum(right_least - x, 0) ** 2
            leftwards = to_left <= to_right
            for here, first, then, bound in ((leftwards, left, right, to_right), (~leftwards, right, left, to_left)):
                some = rows[here]
                visit(first, some)
                visit(then, some[bound[here] <= best[some]])  # an equal bound may hold a lower index

        visit(0, np.arange(len(points)))
        return index, best


@dataclass
class Codebooks:
    """(parts, entries, width of a part) integers, and the length of the vectors that they code."""

    entries: np.ndarray
    length: int

    def trees(self) -> list[Tree]:
        return [Tree(book) for book in self.entries]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _matrix(batch: pa.RecordBatch, length: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("vector"))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, length)


def _summed(trees: Callable[[], list[Tree]], length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task: the number and the sum of the parts that each entry got, by slot (part, entry, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, n, total = trees(), None, None
        for batch in batches:
            vectors = _matrix(batch, length)
            width, entries = length // len(books), len(books[0].entries)
            if n is None:
                n, total = np.zeros((len(books), entries), np.int64), np.zeros((len(books), entries, width), np.int64)
            for p, tree in enumerate(books):
                part = vectors[:, p * width : (p + 1) * width]
                index, _ = tree.nearest(part)
                n[p] += np.bincount(index, minlength=entries)
                for c in range(width):  # a batch's sums are below 2 ** 53, hence exact
                    total[p, :, c] += np.bincount(index, weights=part[:, c], minlength=entries).astype(np.int64)
        if n is not None:
            width = total.shape[2]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(np.repeat(n.ravel(), width)), pa.array(total.ravel())], names=["slot", "n", "total"])

    return run


def _coded(trees: Callable[[], list[Tree]], length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = trees()
        width = length // len(books)
        for batch in batches:
            vectors = _matrix(batch, length)
            codes, error = np.zeros((len(vectors), len(books)), np.uint8), np.zeros(len(vectors), np.int64)
            for p, tree in enumerate(books):
                index, apart = tree.nearest(vectors[:, p * width : (p + 1) * width])
                codes[:, p] = index
                error += apart
            text, step = codes.tobytes().hex(), 2 * len(books)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([text[k : k + step] for k in range(0, len(text), step)], pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    return run


def whole(df: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int = PARTS) -> tuple[DataFrame, int]:
    """(id, label, vector) of the vectors that can be coded, as integers, and their length (0 if there are none)."""
    x = F.col(vector_col)
    plain = x.isNotNull() & (F.size(x) > 0) & (F.size(x) % parts == 0) & F.forall(x, lambda c: F.coalesce(F.abs(c) <= LARGEST, F.lit(False)))
    vector = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("int"))
    rows = durable(df.filter(plain).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), vector.alias("vector")))
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").select(F.size("vector")).first()
    length = first[0] if first else 0
    return rows.filter(F.size("vector") == length), length


def learn(rows: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """The codebooks after ``rounds`` rounds over the rows of ``whole``."""
    if entries > 256:
        raise ValueError("a code has two hex digits for each part, so at most 256 entries")
    start = [r[0] for r in rows.filter("id is not null").orderBy("id", "vector").limit(entries).select("vector").collect()]
    if not start:
        return Codebooks(np.zeros((parts, 0, 0), np.int64), length)
    width = length // parts
    now = np.array(start, np.int64).reshape(len(start), parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        trees = shared(rows.sparkSession, Codebooks(now, length).trees())
        sums = rows.select("vector").mapInArrow(_summed(trees, length), "slot long, n long, total long")
        flat = now.reshape(-1)
        for slot, n, total in sums.groupBy("slot").agg(F.sum("n"), F.sum("total")).collect():  # a row for each integer of the codebooks
            if n:
                flat[slot] = total // n
    return Codebooks(now, length)


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """Per row of ``whole``: id, label, code (two hex digits for each part) and error (squared distance)."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"id {kinds['id']}, label {kinds['label']}, code string, error long"
    if not books.entries.size:
        return rows.limit(0).selectExpr("id", "label", "cast(null as string) code", "cast(null as long) error")
    return rows.select("id", "label", "vector").mapInArrow(_coded(shared(rows.sparkSession, books.trees()), books.length), schema)


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """``codes`` with ``vector``: the components that each code stands for, in the units of the input."""
    flat = F.lit(books.entries.ravel().tolist()) if books.entries.size else F.array().cast("array<long>")
    parts, entries, width = books.entries.shape
    index = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    pieces = [F.slice(flat, F.lit(p * entries * width + 1) + index(p) * width, F.lit(width)) for p in range(parts)]
    return codes.withColumn("vector", F.transform(F.concat(*pieces), lambda v: v / SCALE))


def compress(df: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Per vector: id, code, error, label_error (over all rows with the same label) and codebooks_sha256."""
    rows, length = whole(df, id_col, vector_col, label_col, parts)
    books = learn(rows, length, parts, entries, rounds)
    same = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    coded = durable(encode(rows, books).withColumn("same", same))
    sums = durable(coded.groupBy("same").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("rows")))
    return joined_by(coded, sums, "same", "rows").select("id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
