"""MinHash near-dedup with odd sketches.

1. Each text becomes the set of its distinct 5-word shingles, as 64-bit hashes, and from it: 256 MinHash
   samples, of which 128 make 32 bands of 4; an odd sketch, the parity bitmap of all samples folded into
   1024 bits; and a 128-bit fingerprint of the set. Documents with equal sets form one class at once, whatever their
   number; all that follows sees one row for each class.
2. Classes that share a band are candidates. In each bucket the hubs (the lowest and the highest class)
   stand against all members, which gives rows in proportion to the bucket, not to its square. A pair goes
   on if the size bound and the odd sketches allow 75 %: the population count of the two bitmaps' XOR
   estimates the similarity, with a margin of five standard errors. The full sets decide.
3. Connected components of the confirmed links. Buckets that still hold more than one component then set
   each class outside the bucket's largest component against all classes of other components in the bucket, but for
   the hubs, whose pairs have been decided: semi-joins keep the classes whose bitmaps allow a link at
   all. Small buckets are joined with themselves, on bitmaps and then full sets. Larger ones are dealt into blocks of bounded
   size, and each task takes two blocks: the sizes of all intersections of two full sets are a product of two matrices, whose columns
   are the shingles that several of the sets have. A task gives out what its links connect, a row for each class at most, never its
   pairs. So no pair of a bucket goes unseen, except inside one component, where a link changes nothing.

A pair at 75 % shares no band with a probability of (1 - 0.75 ** 4) ** 32, about 5e-6.

Defined results: documents without words (null and empty texts too) have empty sets and are linked with
nothing; fewer than five words are one shingle. Rows that share an id share a document; null ids are
kept apart by their sets, and their component is the smallest id in it, null if it has none. Texts of any length are
read whole; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, durable, joined_by, united

WORDS, PERCENT = 5, 75
BANDS, ROWS, SAMPLES, SKETCH_WORDS = 32, 4, 256, 16
SKETCH_BITS = SKETCH_WORDS * 64
#: Lowest estimate that goes on to the full sets.
LEAST_ESTIMATE = 0.6

#: Buckets of more classes than this are dealt into blocks, each of so many classes and shingles at most (a larger set is alone in its block).
SMALL_BUCKET, BLOCK_ROWS, BLOCK_SHINGLES = 48, 512, 1 << 18
#: So many columns of a product of matrices are made at once.
_COLUMNS = 2048

#: The component steps spread over so many tasks that each has about this many edges.
EDGES_A_TASK = 100_000

_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 1 << 64, 256, dtype=np.uint64, endpoint=False)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SEEDS = _rng.integers(1, 1 << 64, SAMPLES, dtype=np.uint64, endpoint=False) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9FB21C651E98DF25)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    return x ^ (x >> np.uint64(33))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and the number of words of each row."""
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], solid[:-1]])
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.concatenate([solid[1:], [False]])
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    lengths = ends - starts
    begun = np.zeros(len(data), np.int64)
    begun[starts] = np.diff(starts, prepend=0)
    place = np.arange(len(data)) - np.cumsum(begun)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(lengths.max()), _BASE)]), dtype=np.uint64)
    terms = np.where(solid, _BYTE[data] * powers[np.minimum(place, len(powers) - 1)], np.uint64(0))
    return mix(np.add.reduceat(terms, starts) + lengths.astype(np.uint64)), counts


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each row, sorted within the row, and the rows' offsets in them."""
    words, counts = word_hashes(data, offsets)
    ends = np.cumsum(counts)
    begins = ends - counts
    total = len(words)
    whole = np.zeros(total, np.uint64)
    for i in range(WORDS):
        part = words[i : max(i, total - WORDS + 1 + i)] * np.uint64(2 * i + 3)
        whole[: len(part)] = mix(whole[: len(part)] * _BASE + part)
    n = np.where(counts >= WORDS, counts - WORDS + 1, (counts > 0).astype(counts.dtype))
    row = np.repeat(np.arange(len(counts)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begins, n)
    values = whole[at] if total else whole
    for i in np.flatnonzero((counts > 0) & (counts < WORDS)):
        short = np.full(1, counts[i], np.uint64)
        for w in words[begins[i] : ends[i]]:
            short = mix(short * _BASE + w)
        values[np.searchsorted(row, i)] = short[0]
    firsts = np.concatenate([[0], np.cumsum(n)])
    for i in np.flatnonzero(n > 1):
        values[firsts[i] : firsts[i + 1]].sort()
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (values[1:] != values[:-1])
    row, values = row[keep], values[keep]
    return values, np.searchsorted(row, np.arange(len(counts) + 1))


def sketches(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows with a shingle at least: 128-bit fingerprints, band keys and odd sketches."""
    starts = bounds[:-1]
    n = len(starts)
    prints = np.empty((n, 2), np.uint64)
    prints[:, 0] = mix(np.add.reduceat(mix(values ^ _M1), starts) + np.diff(bounds).astype(np.uint64))
    prints[:, 1] = mix(np.add.reduceat(mix(values ^ _M2), starts))
    samples = np.empty((SAMPLES, n), np.uint64)
    for lo in range(0, n, 64):  # rows whose shingles stay in the processor's cache
        hi = min(n, lo + 64)
        part, own = values[bounds[lo] : bounds[hi]], starts[lo:hi] - bounds[lo]
        for i in range(SAMPLES):
            samples[i, lo:hi] = np.minimum.reduceat(part * _SEEDS[i], own)
    keys = np.zeros((BANDS, n), np.uint64)
    for j in range(ROWS):
        keys = mix(keys * _BASE + samples[j : BANDS * ROWS : ROWS])
    keys = mix(keys + np.arange(BANDS, dtype=np.uint64)[:, None] * _M2)
    place = mix(samples + np.arange(SAMPLES, dtype=np.uint64)[:, None] * _M1) % np.uint64(SKETCH_BITS)
    odd = np.zeros((SKETCH_WORDS, n), np.uint64)
    for i in range(SAMPLES):
        np.bitwise_xor.at(odd, ((place[i] >> np.uint64(6)).astype(np.int64), np.arange(n)), np.uint64(1) << (place[i] & np.uint64(63)))
    return prints, keys.T, odd.T


SKETCHED = f"n long, print binary, keys array<long>, {', '.join(f'odd{i} long' for i in range(SKETCH_WORDS))}"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in byte_slices(batch, "data", 1 << 21):
            values, bounds = shingle_sets(data, offsets)
            n = np.diff(bounds)
            full = np.flatnonzero(n)
            prints, keys, odd = np.zeros((b - a, 2), np.uint64), np.zeros((b - a, BANDS), np.uint64), np.zeros((b - a, SKETCH_WORDS), np.uint64)
            if len(full):
                prints[full], keys[full], odd[full] = sketches(values, np.concatenate([bounds[full], bounds[-1:]]))
            print_bytes = [None if not m else p.tobytes() for m, p in zip(n, prints, strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [*(c.slice(a, b - a) for c in batch.columns[:2]), pa.array(n.astype(np.int64)), pa.array(print_bytes, pa.binary()), lists, *(pa.array(np.ascontiguousarray(odd[:, i]).view(np.int64)) for i in range(SKETCH_WORDS))],
                names=["id", "text_hash", "n", "print", "keys", *(f"odd{i}" for i in range(SKETCH_WORDS))],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of each text, sorted by its hashes as unsigned numbers."""
    for batch in batches:
        for a, b, data, offsets in byte_slices(batch, "data", 1 << 21):
            values, bounds = shingle_sets(data, offsets)
            sets = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), sets], names=["node", "set"])


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def allowed(left: str, right: str) -> Column:
    """Whether sizes and odd sketches of two classes allow the similarity."""
    small, large = F.least(f"{left}.n", f"{right}.n"), F.greatest(f"{left}.n", f"{right}.n")
    apart = functools.reduce(operator.add, (F.bit_count(F.col(f"{left}.odd{i}").bitwiseXOR(F.col(f"{right}.odd{i}"))) for i in range(SKETCH_WORDS)))
    # The estimate 1 + bits / (4 samples) * ln(1 - 2 apart / bits), solved for the population count.
    most = int(SKETCH_BITS / 2 * (1 - np.exp((LEAST_ESTIMATE - 1) * 4 * SAMPLES / SKETCH_BITS)))
    return (100 * small >= PERCENT * large) & (apart <= most)


def alike(left: str, right: str) -> Column:
    """Whether two full sets reach the similarity."""
    both = F.size(F.array_intersect(f"{left}.set", f"{right}.set"))
    return 100 * both >= PERCENT * (F.size(f"{left}.set") + F.size(f"{right}.set") - both)


def full_sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, set) of the distinct nodes, from their texts alone."""
    wanted = classes.join(nodes.distinct(), "node", "left_semi").select("node", "id", "text_hash")
    # A sieve of 2 ** 20 places at most keeps most other texts out of the shuffle.
    place = F.pmod(F.xxhash64("id", "text_hash"), F.lit(1 << 20))
    near = docs.withColumn("place", place).join(F.broadcast(wanted.select(place.alias("place")).distinct()), "place", "left_semi")
    texts = near.join(wanted, near["id"].eqNullSafe(wanted["id"]) & (near["text_hash"] == wanted["text_hash"])).select("node", "data").dropDuplicates(["node"])
    return durable(texts.mapInArrow(_sets, "node long, set array<long>"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for each node of an edge.

    Large-star and small-star steps in turn: each node's neighbours are linked to its smallest one, the
    larger neighbours first, then the smaller, until nothing changes. Each step is an aggregate and a join,
    so a node with many neighbours needs no task of its own, and the number of rounds grows as the
    logarithm of the longest path.
    """

    def fingerprint(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    first = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    parts = max(2, -(-edges.count() // EDGES_A_TASK))  # few edges don't fill many files
    now = durable(first.distinct().coalesce(parts))
    last = fingerprint(now)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").coalesce(parts)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = durable(small.filter("u <> v").coalesce(parts).distinct().coalesce(parts))
        if (state := fingerprint(now)) == last:
            break
        last = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The sizes of the intersections of each left set with each right one; ``left`` and ``right`` are places in ``sets``."""
    lengths = np.array([len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), lengths)
    several = (times > 1)[column]  # a shingle of one set only is in no intersection
    row, column = row[several], (np.cumsum(times > 1) - 1)[column[several]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    found = np.zeros((len(left), len(right)), np.float32)  # counts below 2 ** 24 are exact
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, [first, first + _COLUMNS])
        cells = np.zeros((len(sets), _COLUMNS), np.float32)
        cells[row[a:b], column[a:b] - first] = 1
        found += cells[left] @ cells[right].T
    return found.astype(np.int64)


def _connected(block: pa.Table) -> pa.Table:
    """What the links between two blocks of a bucket connect: (a, b), each class with the first of those that it is connected with."""
    sets = [np.asarray(s) for s in (x.values.to_numpy() for x in block.column("set"))]
    nodes, roots, lengths = block.column("node").to_numpy(), block.column("root").to_numpy(), np.array([len(s) for s in sets])
    side = block.column("right").to_numpy(zero_copy_only=False).astype(bool)
    left, right = np.flatnonzero(~side), np.flatnonzero(side)
    if not len(right):
        right = left
    both = shared_counts(sets, left, right) if len(left) and len(right) else np.zeros((len(left), len(right)), np.int64)
    hits = (100 * both >= PERCENT * (lengths[left][:, None] + lengths[right][None, :] - both)) & (roots[left][:, None] != roots[right][None, :])
    u, v = np.nonzero(hits)
    root = united(len(sets), left[u], right[v])
    linked = np.flatnonzero(root != np.arange(len(sets)))
    return pa.table([pa.array(nodes[root[linked]]), pa.array(nodes[linked])], names=["a", "b"])


def late_links(near: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): classes of one bucket (key, node, root, main, n) that links connect, for all pairs that are not both in ``main`` or in one root."""
    out = F.col("root") != F.col("main")
    sizes = durable(near.groupBy("key").agg(
        F.count(F.lit(1)).alias("members"), F.count(F.lit(1)).alias("rows"), F.count_if(out).alias("n_out"), F.sum(F.when(out, F.col("n")).otherwise(0)).alias("s_out"), F.sum(F.when(~out, F.col("n")).otherwise(0)).alias("s_main")
    ))
    placed = joined_by(near.select("key", "node", "root", "main"), sizes, "key", "members")
    few = placed.filter(F.col("rows") <= SMALL_BUCKET).select("key", "node", "root", "main").join(sets, "node")
    x, y = few.filter(out).alias("x"), few.alias("y")
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root"))
    once = (F.col("y.root") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))
    small, large = F.least(F.size("x.set"), F.size("y.set")), F.greatest(F.size("x.set"), F.size("y.set"))
    found = x.join(y, apart & once & (100 * small >= PERCENT * large) & alike("x", "y")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))

    blocks = lambda n, s: F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(s / BLOCK_SHINGLES), F.lit(1)).cast("int")
    many = placed.filter((F.col("rows") > SMALL_BUCKET) & (F.col("n_out") > 0)).withColumns({"b_out": blocks(F.col("n_out"), F.col("s_out")), "b_main": blocks(F.col("rows") - F.col("n_out"), F.col("s_main"))})
    many = many.withColumn("own", F.pmod(F.xxhash64("node"), F.when(out, F.col("b_out")).otherwise(F.col("b_main"))).cast("int"))
    others = lambda n: F.sequence(F.lit(0), n - 1)
    task = lambda kind, i, j, right: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), right.alias("right"))
    own = F.col("own")
    with_outside = F.transform(others(F.col("b_out")), lambda c: task("outside", F.least(own, c), F.greatest(own, c), own > c))
    with_main = F.transform(others(F.col("b_main")), lambda c: task("main", own, c, F.lit(False)))
    from_main = F.transform(others(F.col("b_out")), lambda c: task("main", c, own, F.lit(True)))
    dealt = many.select("key", "node", "root", F.inline(F.when(out, F.concat(with_outside, with_main)).otherwise(from_main)))
    joined = dealt.join(sets, "node").groupBy("key", "kind", "i", "j").applyInArrow(_connected, "a long, b long")
    return found.union(joined).distinct()


def near_duplicates(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id reachable) and kept (id = component_id)."""
    return verdicts(df, id_col, text).drop("text_hash", "root")


def verdicts(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """``near_duplicates`` with each row's text_hash and its component's root, a number that is null for empty sets."""
    docs = df.select(F.col(id_col).alias("id"), text_hash(text).alias("text_hash"), F.coalesce(text, F.lit("")).cast("binary").alias("data"))
    kind = docs.schema["id"].dataType.simpleString()
    rows = durable(docs.mapInArrow(_sketch, f"id {kind}, text_hash long, {SKETCHED}"))
    odd = [f"odd{i}" for i in range(SKETCH_WORDS)]
    classes = durable(
        rows.filter("n > 0")
        .groupBy("print")
        .agg(F.min(F.struct("id", "text_hash")).alias("first"), F.min("id").alias("least"), F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.first("keys").alias("keys"), *(F.first(c).alias(c) for c in odd))
        .select("print", "first.*", "least", "rows", "n", "keys", *odd)
        .withColumn("node", F.monotonically_increasing_id())
    )
    members = classes.select("node", F.explode("keys").alias("key"))
    ends = members.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("top")).filter("low <> top")
    shared = durable(members.join(ends, "key"))
    light = classes.select("node", "n", *odd)  # what candidates are judged by

    def judged(pairs: DataFrame) -> DataFrame:
        x, y = light.alias("x"), light.alias("y")
        return pairs.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node")).filter(allowed("x", "y")).select("a", "b")

    stars = shared.select(F.col("low").alias("a"), F.col("node").alias("b")).union(shared.select(F.col("node").alias("a"), F.col("top").alias("b"))).filter("a <> b").distinct()
    pairs = durable(judged(stars))
    sets = full_sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), classes, docs)
    x, y = sets.alias("x"), sets.alias("y")
    links = durable(pairs.join(x, F.col("a") == F.col("x.node")).join(y, (F.col("b") == F.col("y.node")) & alike("x", "y")).select("a", "b"))
    roots = durable(components(links))

    # Buckets of more than one component: what isn't in the largest against the other components.
    named = shared.join(roots, "node", "left").select("key", "low", "top", "node", F.coalesce("root", "node").alias("root"))
    sizes = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("many"))
    mixed = sizes.groupBy("key").agg(F.max_by("root", "many").alias("main"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    unseen = named.filter("node <> low and node <> top")  # the hubs have met all members of their buckets
    left_over = durable(unseen.join(mixed.select("key", "main"), "key").select("key", "node", "root", "main").join(light, "node"))
    outside = left_over.filter("root <> main")
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root"))
    found = [x.join(y, apart & allowed("x", "y"), "left_semi") for x, y in ((outside.alias("x"), left_over.alias("y")), (left_over.filter("root = main").alias("x"), outside.alias("y")))]
    near = durable(found[0].union(found[1]))
    late = durable(late_links(near.select("key", "node", "root", "main", "n"), full_sets(near.select("node"), classes, docs)))
    if not late.isEmpty():
        roots = durable(components(links.union(late)))

    placed = classes.select("print", "node", "least", "rows").join(roots, "node", "left").select("print", "least", "rows", F.coalesce("root", "node").alias("root"))
    component = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = durable(placed.join(component, "root").select("print", "component_id", "root", "rows"))
    full = joined_by(rows.filter("n > 0").select("id", "text_hash", "n", "print"), by_print, "print", "rows").select("id", "text_hash", F.col("n").alias("n_shingles"), "component_id", "root")
    empty = rows.filter("n = 0").select("id", "text_hash", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(None).cast("long").alias("root"))
    return full.union(empty).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
