"""Alignment of two tokenizers over the same texts.

Tokens of A and of B that share a byte are joined by an edge; union-find over these edges gives connected components, which
are exactly the minimal groups of tokens that cover the same bytes. Within a component every A token and B
token that end on the same byte are a link. Links are counted by their pair of ids: first within each text, then within
each task, then by Spark. With the counts, each text gets the sum over its links and how many of them are the best that their B
token has anywhere in the corpus.

A is a byte-level BPE vocabulary in JSON, B a SentencePiece model; both come as files whose paths are parameters of
``Vocabularies.read``, and go to the tasks as bytes (some 3 MB). A is run by tiktoken's merging, with the JSON's own ids as ranks.

The table of counts has at most |A| x |B| rows. Up to ``SMALL`` pairs (12 bytes each) it is broadcast; beyond that each text's
pairs are joined with it, the pairs that most texts have by broadcast, the others by a shuffle.

Defined results: null and empty texts, texts that either tokenizer doesn't give back byte by byte, and texts that aren't
valid UTF-8 have no tokens: zeros, and empty groups. Strings of special tokens are plain text. Ids may be null or repeat; each row has its
result. Texts of any length are read whole; equal counts are best together. Other columns, whatever their names, are
not read. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, durable, joined_by, shared, united

#: Most pairs that are broadcast.
SMALL = 1 << 22
#: How byte-level BPE of this kind cuts a text before it merges. Fixed value of the public vocabulary's format.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


@dataclass
class Vocabularies:
    """The files' contents."""

    a_json: bytes
    b_model: bytes

    @classmethod
    def read(cls, spark: SparkSession, a_path: str, b_path: str) -> Vocabularies:
        """Reads both files by Spark, wherever they lie."""
        found = {}
        for k, path in (("a_json", a_path), ("b_model", b_path)):
            rows = spark.read.format("binaryFile").load(path if "://" in path else f"file://{path}").select("content").take(1)
            found[k] = bytes(rows[0][0])
        return cls(**found)


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte: itself where it is visible in Latin-1, else the next from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def byte_vocabulary(a_json: bytes) -> tuple[dict[bytes, int], list[bytes]]:
    """(ids by bytes, without special tokens; bytes by id). The merges have to stand in the order of their ids, as ranks do."""
    parsed = json.loads(a_json)
    letters, special = byte_letters(), {t["id"] for t in parsed.get("added_tokens", ())}
    vocabulary = parsed["model"]["vocab"]
    ranks = {bytes(letters[c] for c in token): k for token, k in vocabulary.items() if k not in special}
    made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in parsed["model"]["merges"]]
    ids = [vocabulary[m] for m in made]
    if ids != sorted(ids):
        raise ValueError("the merges' order is not that of the ids")
    by_id = [b""] * (max(vocabulary.values()) + 1)
    for token, k in ranks.items():
        by_id[k] = token
    return ranks, by_id


class Tokenizers:
    """Both tokenizers, made inside a task."""

    def __init__(self, files: Vocabularies) -> None:
        import sentencepiece
        import tiktoken

        ranks, by_id = byte_vocabulary(files.a_json)
        self._a = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_proto=files.b_model)
        pieces = [self._b.id_to_piece(k) for k in range(self._b.get_piece_size())]
        self.bytes = [by_id, [bytes([int(m[1], 16)]) if (m := _BYTE_PIECE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]]
        self.tables = []
        for tokens in self.bytes:
            lengths = np.array([len(t) for t in tokens], np.int64)
            self.tables.append((lengths, np.concatenate([[0], np.cumsum(lengths)[:-1]]), np.frombuffer(b"".join(tokens), np.uint8)))
        most = max(len(t) for t in self.bytes)
        width = len(str(most - 1))
        self.digits, self.digit_counts = np.zeros((most, width + 1), np.uint8), np.ones(most, np.int64)
        for k in range(most):
            text = str(k).encode()
            self.digits[k, : len(text)], self.digit_counts[k] = np.frombuffer(text, np.uint8), len(text)

    def ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return [self._a.encode_ordinary(f" {t}") if t else [] for t in texts], self._b.encode(texts, num_threads=1) if texts else []


def _run(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.array([len(x) for x in ids], np.int64)
    return np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(counts.sum())), counts


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each run, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _exact(tokens: Tokenizers, side: int, ids: np.ndarray, counts: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Whether each text's joined token bytes are a space and the text."""
    lengths, starts, blob = tokens.tables[side]
    own = lengths[ids]
    ends = np.concatenate([[0], np.cumsum(own)])
    of_text = np.concatenate([[0], np.cumsum(counts)])
    joined = blob[_gather(starts[ids], own)].tobytes()
    return np.array([len(t) > 0 and joined[ends[of_text[k]] : ends[of_text[k + 1]]] == b" " + t for k, t in enumerate(texts)], bool)


@dataclass
class Aligned:
    """The alignment of some texts; arrays of all tokens, with each text's number of them."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def aligned(tokens: Tokenizers, texts: list[bytes]) -> Aligned:
    plain = [t.decode(errors="replace") for t in texts]
    found = [_run(x) for x in tokens.ids(plain)]
    good = _exact(tokens, 0, *found[0], texts) & _exact(tokens, 1, *found[1], texts)
    (a, n_a), (b, n_b) = ((ids[np.repeat(good, counts)], np.where(good, counts, 0)) for ids, counts in found)
    ends_a, ends_b = np.cumsum(tokens.tables[0][0][a]), np.cumsum(tokens.tables[1][0][b])
    # Between two neighbouring ends lies one token of A and one of B: an edge.
    cuts = np.concatenate([ends_a, ends_b])
    cuts.sort(kind="stable")
    cuts = cuts[np.diff(cuts, prepend=-1) > 0]
    at_a, at_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
    root = united(len(a) + len(b), at_a, at_b + len(a))
    group = np.cumsum(np.diff(root[: len(a)], prepend=-1) != 0) - 1  # a component's smallest node is its first A token
    together = (ends_a[at_a] == cuts) & (ends_b[at_b] == cuts)
    return Aligned(a, b, n_a, n_b, group, group[root[len(a) :]], at_a[together], at_b[together])


def written(tokens: Tokenizers, found: Aligned) -> list[bytes]:
    """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
    n = len(found.a) + len(found.b)
    if not n:
        return [b""] * len(found.n_a)
    groups = int(found.group_a[-1]) + 1
    before_b = np.concatenate([[0], np.cumsum(np.bincount(found.group_b, minlength=groups))])
    upto_a = np.cumsum(np.bincount(found.group_a, minlength=groups))
    place_a = np.arange(len(found.a)) + before_b[found.group_a]
    place_b = np.arange(len(found.b)) + upto_a[found.group_b]
    ids, mark = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
    ids[place_a], ids[place_b] = found.a, found.b
    mark[place_a[np.diff(found.group_a, append=groups) > 0]] = ord("|")
    mark[place_b[np.diff(found.group_b, append=groups) > 0]] = ord(";")
    lengths = tokens.digit_counts[ids] + 1
    letters = tokens.digits[ids]
    letters[np.arange(n), lengths - 1] = mark
    flat = letters[np.arange(letters.shape[1]) < lengths[:, None]].tobytes()
    ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(found.n_a + found.n_b)])]
    return [flat[s : max(s, e - 1)] for s, e in zip(ends, ends[1:], strict=False)]  # without the last separator


ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups string, n_pairs int, pairs binary"


def _packed(codes: np.ndarray, times: np.ndarray) -> bytes:
    return pa.compress(np.concatenate([codes, times]).astype(np.int64).tobytes(), codec="zstd", asbytes=True)


def unpacked(n: int, pairs: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(codes, times) of a text's distinct pairs; a code is A's id times the size of B, plus B's id."""
    both = np.frombuffer(pa.decompress(pairs, decompressed_size=16 * n, codec="zstd", asbytes=True), np.int64) if n else np.zeros(0, np.int64)
    return both[:n], both[n:]


def _align(files: Callable[[], Vocabularies]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = None
        for batch in batches:
            tokens = tokens or Tokenizers(files())
            size = len(tokens.bytes[1])
            for lo, hi, data, offsets in byte_slices(batch, "data", 1 << 19):
                blob = data.tobytes()
                found = aligned(tokens, [blob[s:e] for s, e in zip(offsets, offsets[1:], strict=False)])
                groups = written(tokens, found)
                of_a = np.concatenate([[0], np.cumsum(found.n_a)])
                text = np.searchsorted(of_a, found.link_a, side="right") - 1
                n_links = np.bincount(text, minlength=hi - lo)
                first = np.flatnonzero(np.diff(found.group_a, prepend=-1))
                n_groups = np.bincount(np.searchsorted(of_a, first, side="right") - 1, minlength=hi - lo)
                codes, cuts = found.a[found.link_a] * size + found.b[found.link_b], np.concatenate([[0], np.cumsum(n_links)])
                own = [np.unique(codes[s:e], return_counts=True) for s, e in zip(cuts, cuts[1:], strict=False)]
                numbers = (found.n_a, found.n_b, n_groups, n_links)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), *(pa.array(x.astype(np.int64)) for x in numbers), pa.array([g.decode() for g in groups], pa.string()), pa.array([len(c) for c, _ in own], pa.int32()), pa.array([_packed(*x) for x in own], pa.binary())],
                    names=["id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_pairs", "pairs"],
                )

    return run


def align(df: DataFrame, id_col: str, text: Column, files: Vocabularies) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, groups (as text) and the text's distinct pairs, packed."""
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).cast("binary").alias("data"))
    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(_align(shared(df.sparkSession, files)), f"id {kind}, {ALIGNED}")


def _each(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    names = batch.schema.names
    for n, pairs in zip(batch.column(names.index("n_pairs")).to_pylist(), batch.column(names.index("pairs")), strict=True):
        yield unpacked(n, pairs.as_buffer())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of a task, counted together as often as a million have come."""
    kept, rows = [], 0

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes, back = np.unique(np.concatenate([k[0] for k in kept]), return_inverse=True)
        return codes, *(np.bincount(back, weights=np.concatenate([k[c] for k in kept]), minlength=len(codes)).astype(np.int64) for c in (1, 2))

    def sent() -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept[0]], names=["code", "n", "texts"])

    for batch in batches:
        for codes, times in _each(batch):
            kept.append((codes, times, np.ones(len(codes), np.int64)))
            rows += len(codes)
            if rows > 1 << 20:
                kept = [merged()]
                rows = len(kept[0][0])
                if rows > 1 << 19:
                    yield from sent()
                    kept, rows = [], 0
    if kept:
        kept = [merged()]
        yield from sent()


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """(code, n, texts, best) over all rows of ``align``: a pair's links, the texts with it, whether n is its B id's highest."""
    counts = rows.select("n_pairs", "pairs").mapInArrow(_counted, "code long, n long, texts long").groupBy("code").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))
    counts = durable(counts.withColumn("b", F.col("code") % size_b))
    highest = counts.groupBy("b").agg(F.max("n").alias("highest"))  # a row for each id of B at most
    return durable(counts.join(F.broadcast(highest), "b").select("code", "n", "texts", (F.col("n") == F.col("highest")).alias("best")))


def _looked_up(table: Callable[[], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n, best = table()
        for batch in batches:
            own = list(_each(batch))
            at = np.searchsorted(codes, np.concatenate([c for c, _ in own]) if own else np.zeros(0, np.int64))
            times = np.concatenate([t for _, t in own]) if own else at
            cuts = np.concatenate([[0], np.cumsum([len(c) for c, _ in own])]).astype(np.int64)
            sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[cuts]) for x in (times * best[at], times * n[at])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(s.astype(np.int64)) for s in sums)], names=["row", "n_best", "count_sum"])

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, (codes, times) in zip(batch.column(0), _each(batch), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), row.as_py())), pa.array(codes), pa.array(times)], names=["row", "code", "times"])


def scored(rows: DataFrame, counts: DataFrame, small: int = SMALL) -> DataFrame:
    """Per ``row`` of ``rows``: n_best and count_sum."""
    spark, own = rows.sparkSession, rows.select("row", "n_pairs", "pairs")
    if counts.count() <= small:
        found = counts.select("code", "n", "best").toArrow().sort_by("code")
        table = tuple(found.column(k).to_numpy().astype(kind) for k, kind in enumerate((np.int64, np.int64, np.int8)))
        return own.mapInArrow(_looked_up(shared(spark, table)), "row long, n_best long, count_sum long")
    each = own.mapInArrow(_spread, "row long, code long, times long")
    joined = joined_by(each, counts, "code", "texts")
    return joined.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))


def size_of_b(files: Vocabularies) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=files.b_model).get_piece_size()


def alignment(df: DataFrame, id_col: str, text: Column, files: Vocabularies, groups: Callable[[Column], Column] = lambda c: c, small: int = SMALL) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups, as ``groups`` makes it from their text."""
    made = align(df, id_col, text, files)
    rows = durable(made.withColumn("groups", groups(F.col("groups"))).withColumn("row", F.monotonically_increasing_id()))
    sums = scored(rows, pair_counts(rows, size_of_b(files)), small)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(sums, "row", "left").select("id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups")
