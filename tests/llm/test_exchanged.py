"""Exact dedup, vector codes and token alignment: round trips and brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightwake.llm import common, exact_dedup, queries, token_alignment, vector_codes

from .helpers import awkward

DIR = "/root/testdata/sf0.01"
CLASHING = "label long, part int, place long, mark string, words string, plain string, row long, `key` string, code string, n long, error long"


# ---- exact duplicates

@pytest.mark.parametrize("n, most", [(1, 1), (1, 1 << 40), (1000, 1000), (5000, 5000 * 256), (300, 1 << 43)])
def test_golomb_round_trip(n, most):
    values = np.unique(np.random.default_rng(n).integers(0, most, n, dtype=np.uint64))
    power, unary, rest = exact_dedup.golomb(values)
    assert np.array_equal(exact_dedup.ungolomb(len(values), power, unary, rest), values)
    if n == 5000:
        assert 8 * (len(unary) + len(rest)) < 10.5 * len(values)  # 256 times as sparse: log2(256) + 1.5 bits or so


def exact(rows):
    """doc_id, text pairs to the rows of the contract, one by one."""
    plain = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for (i, _), p in zip(rows, plain, strict=True):
        groups[p].append(i)
    least = {p: min((i for i in ids if i is not None), default=None) for p, ids in groups.items()}
    return Counter((i, least[p], len(groups[p]), i == least[p], hashlib.sha256(p.encode()).hexdigest()) for (i, _), p in zip(rows, plain, strict=True))


def exact_of(df):
    return Counter(tuple(r) for r in exact_dedup.exact_groups(df, "doc_id", F.col("text")).collect())


def test_exact_groups_of_awkward_rows(spark):
    df = awkward(spark)
    assert exact_of(df) == exact([(r["doc_id"], r["text"]) for r in df.collect()])
    assert not exact_of(df.limit(0))


def test_exact_groups_with_a_hot_text_and_rows_without_ids(spark):
    rng = random.Random(3)
    rows = [(k, "the hot one" if k % 3 == 0 else f"text {rng.randrange(1500)}" + rng.choice([" ", "\t\n", "  ", " ", "  x"])) for k in range(4000)]
    rows += [(None, "the  hot one"), (None, "alone without id"), (None, "alone without id"), (7, "text 7 "), (7, "text 7 ")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert exact_of(df) == exact(rows)


def test_only_suspects_leave_their_partitions(spark):
    """The fingerprints of different texts are told apart: few rows without a copy are suspects."""
    marks = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 20_000)
    most = 256 * len(marks)
    values = marks.view(np.uint64) % np.uint64(most)
    assert len(values) - len(np.unique(values)) < len(values) / 200


# ---- vector codes

def nearest_by_force(entries, points):
    apart = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
    return np.argmin(apart, axis=1), apart.min(axis=1)


@pytest.mark.parametrize("spread", [1, 3, 40, 1 << 26])
def test_tree_gives_the_lowest_of_equal_entries(spread):
    rng = np.random.default_rng(spread)
    for k in (1, 2, 5, 64):
        entries = rng.integers(-spread, spread + 1, (k, 4))
        points = np.concatenate([rng.integers(-2 * spread, 2 * spread + 1, (500, 4)), entries, (entries + entries[::-1]) // 2])
        index, best = vector_codes.Tree(entries).nearest(points)
        want = nearest_by_force(entries, points)
        assert np.array_equal(index, want[0]) and np.array_equal(best, want[1])


def codes_by_force(rows, parts=16, entries=64, rounds=2):
    """(id, vector, label) rows to the contract's rows, in plain Python."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted((k for k in kept if k[0] is not None), key=lambda k: (k[0], k[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), n) for n, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            got = defaultdict(list)
            for _, v, _ in kept:
                got[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(got[n]) for c in zip(*got[n], strict=True)] if n in got else e for n, e in enumerate(books[p])]
    found = [(i, [near(cut(v, p), books[p]) for p in range(parts)], label) for i, v, label in kept]
    by = Counter()
    for _, got, label in found:
        by[label] += sum(d for d, _ in got)
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return Counter((i, "".join(f"{n:02x}" for _, n in got), sum(d for d, _ in got), by[label], digest) for i, got, label in found)


def codes_of(df):
    return Counter(tuple(r) for r in vector_codes.compress(df, "vec_id", "embedding", "label").collect())


def test_codes_against_brute_force(spark):
    rng = random.Random(8)
    vector = lambda: [rng.choice([-1.0, -0.004, 0.0, 0.5, rng.uniform(-2, 2)]) for _ in range(32)]
    rows = [(k, vector(), rng.choice([None, 1, 2])) for k in range(150)]
    rows += [(200, None, 1), (201, [None] + [0.0] * 31, 1), (202, [float("nan")] + [0.0] * 31, 2), (203, [float("inf")] + [0.0] * 31, 2), (None, vector(), 1), (5, rows[5][1], None), (5, rows[5][1], None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    stored = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    assert codes_of(df) == codes_by_force(stored)
    more = df.selectExpr("*", "1 as id", "'x' as vector", "2 as slot", "'y' as same", "3 as rows")
    assert codes_of(more) == codes_by_force(stored)


def test_codes_of_few_rows_and_of_none(spark):
    schema = "vec_id long, embedding array<float>, label int"
    few = spark.createDataFrame([(1, [1.0] * 16, None), (2, [2.0] * 16, None), (3, [1e30] * 16, None), (4, [1.0] * 7, 1), (5, [], 1), (6, [1.0] * 32, 1)], schema)
    assert {(r["id"], r["code"], r["error"], r["label_error"]) for r in vector_codes.compress(few, "vec_id", "embedding", "label").collect()} == {(1, "00" * 16, 0, 0), (2, "01" * 16, 0, 0)}
    assert not codes_of(few.limit(0))


def test_decoded_vectors_are_as_far_as_the_error_says(spark):
    rows, length = vector_codes.whole(spark.read.parquet(f"{DIR}/embeddings.parquet"), "vec_id", "embedding", "label")
    books = vector_codes.learn(rows, length)
    found = {r["id"]: r for r in vector_codes.decode(vector_codes.encode(rows, books), books).collect()}
    for r in rows.limit(50).collect():
        back = found[r["id"]]
        assert sum((a - round(256 * b)) ** 2 for a, b in zip(r["vector"], back["vector"], strict=True)) == back["error"]


# ---- token alignment

@pytest.fixture(scope="module")
def files(spark):
    return token_alignment.Vocabularies.read(spark, f"{queries.TOKENIZERS}/byte_bpe_50k.json", f"{queries.TOKENIZERS}/piece_bpe_32k.model")


def test_union_find():
    rng = np.random.default_rng(2)
    for n in (1, 10, 300):
        u, v = rng.integers(0, n, (2, n))
        root = list(range(n))
        for _ in range(n):
            for a, b in zip(u, v, strict=True):
                root[a] = root[b] = min(root[a], root[b])
        assert common.united(n, u.copy(), v.copy()).tolist() == root
    path = np.arange(999)
    assert not common.united(1000, path.copy(), path + 1).any()


def aligned_by_force(texts):
    """The contract's row for each text, by the other library and plain loops."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{queries.TOKENIZERS}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{queries.TOKENIZERS}/piece_bpe_32k.model")
    letters = token_alignment.byte_letters()
    piece = lambda p: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
    every, counts = [], Counter()
    for text in texts:
        ids = [], []
        if text:
            ids = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
            tokens = [bytes(letters[c] for c in a.id_to_token(k)) for k in ids[0]], [piece(b.id_to_piece(k)) for k in ids[1]]
            if any(b"".join(t) != f" {text}".encode() for t in tokens):
                ids = [], []
        ends = [], []
        if ids[0]:
            for own, side in zip(tokens, ends, strict=True):
                at = 0
                for t in own:
                    side.append(at := at + len(t))
        groups, links, i, j = [], [], 0, 0
        place = {t: y for y, t in enumerate(ends[1])}
        for x, cut in enumerate(ends[0]):
            if cut in place:
                y = place[cut]
                groups.append((ids[0][i : x + 1], ids[1][j : y + 1]))
                links.append((ids[0][x], ids[1][y]))
                i, j = x + 1, y + 1
        counts.update(links)
        every.append((len(ids[0]), len(ids[1]), groups, links))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    found = []
    for n_a, n_b, groups, links in every:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        found.append((n_a, n_b, len(groups), len(links), sum(counts[k] == best[k[1]] for k in links), sum(counts[k] for k in links), text))
    return found


TEXTS = [
    None, "", " ", "\n", "one two three", "one two three", "  two  spaces\tand\ttabs\r\n", "naïve café — “quotes” … ﬁne №5", "漢字かな交じり文 한국어 हिन्दी ไทย", "🙂🙃👩‍👩‍👧 flags 🇳🇴", "▁ is the piece's own mark", "<|endoftext|> and <s> </s> <unk> <0x41>",
    "x" * 300, "1234567890" * 20, "it's they'll we've", "é combining", " no-break em　wide", "\x00\x01 control", "café", "the " * 400, "def f(x):\n    return {'a': [1, 2]}\n",
]


@pytest.mark.parametrize("small", [token_alignment.SMALL, 3])
def test_alignment_against_brute_force(spark, files, small):
    rows = [(k if k != 4 else None, t) for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "1 as id", "2 as n_a", "'x' as groups", "3 as row", "'y' as data")
    found = token_alignment.alignment(df, "doc_id", F.col("text"), files, small=small).collect()
    want = aligned_by_force(TEXTS)
    assert Counter(tuple(r) for r in found) == Counter((i, *w) for (i, _), w in zip(rows, want, strict=True))


def test_alignment_of_the_table_against_brute_force(spark, files):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    found = {r["doc_id"]: r for r in queries.op13_token_alignment(spark, "/root/testdata/sf0.001").collect()}
    for d, w in zip(docs, aligned_by_force([d["text"] for d in docs]), strict=True):
        r = found[d["doc_id"]]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"]) == w[:6]
        assert r["groups_sha256"] == (hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "")


def test_alignment_of_awkward_rows_and_none(spark, files):
    df = awkward(spark)
    found = token_alignment.alignment(df, "doc_id", F.col("text"), files).collect()
    assert len(found) == df.count() and {r["n_a"] for r in found if r["id"] in (2, 3)} == {0}
    assert token_alignment.alignment(df.limit(0), "doc_id", F.col("text"), files).count() == 0
