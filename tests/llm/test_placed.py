"""Near duplicates, secrets, mixing, packing, sharding and media: brute force and round trips."""

import hashlib
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightwake.llm import common, media, near_dedup, packing, queries, secret_scan, sharding, source_mix

from .helpers import CLASHING, awkward, near_groups, shingles

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


# ---- near duplicates

def test_near_duplicates_against_all_pairs(spark, docs):
    want = near_groups([(i, r["text"]) for i, r in docs.items()])
    for r in queries.op5_near_dedup(spark, DIR).collect():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(shingles(docs[r["doc_id"]]["text"])), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


def test_chains_and_stars(spark):
    """Members that are near a centre only, and chains whose ends are far apart."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts = []
    for k in range(40):
        words = list(base)
        for at in rng.sample(range(200), rng.choice([2, 5, 9, 12])):
            words[at] = f"edit{k}x{at}"
        texts.append(" ".join(words))
    chain = [f"c{i}" for i in range(120)]
    for k in range(12):
        texts.append(" ".join(chain[4 * k :] + [f"n{k}x{i}" for i in range(4 * k)][:0] + [f"tail{i}" for i in range(4 * k)]))
    rows = [(100 - i, t) for i, t in enumerate(texts)]
    want = near_groups(rows)
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", F.col("text")).collect()
    assert {r["id"]: r["component_id"] for r in found} == want


def test_near_duplicates_of_awkward_rows(spark):
    rows = awkward(spark)
    found = near_dedup.near_duplicates(rows, "doc_id", F.col("text")).collect()
    by = {r["id"]: r for r in found}
    assert len(found) == rows.count()
    assert by[5]["component_id"] == 1 and not by[5]["kept"] and by[1]["kept"]
    assert by[2]["n_shingles"] == by[3]["n_shingles"] == by[4]["n_shingles"] == 0 and by[2]["kept"] and by[4]["component_id"] == 4
    assert by[8]["n_shingles"] == 1 and by[8]["kept"] and by[None]["component_id"] is None
    assert near_dedup.near_duplicates(spark.createDataFrame([], CLASHING), "doc_id", F.col("text")).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for j in (0.5, 0.75, 0.95):
        n = 4000
        both = rng.integers(0, 1 << 63, int(n * j), dtype=np.uint64)
        rest = rng.integers(0, 1 << 63, n - len(both), dtype=np.uint64)
        a, b = np.sort(np.concatenate([both, rest[::2]])), np.sort(np.concatenate([both, rest[1::2]]))
        _, _, odd = near_dedup.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        apart = sum(bin(int(x)).count("1") for x in odd[0] ^ odd[1])
        estimate = 1 + near_dedup.SKETCH_BITS / (4 * near_dedup.SAMPLES) * np.log(1 - 2 * apart / near_dedup.SKETCH_BITS)
        assert abs(estimate - j) < 0.13


# ---- secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_spans(text):
    t = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(spans)


def listed(spans):
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_base_spans(spark, docs):
    for r in queries.op3_secret_scan(spark, DIR).collect():
        spans = brute_spans(docs[r["doc_id"]]["text"])
        assert r["base_sha256"] == hashlib.sha256(listed(spans).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == j for _, k, _ in spans) for j in range(3)]
        assert set(filter(None, listed(spans).split(","))) <= set(r["spans"].split(","))


@pytest.fixture(scope="module")
def model(spark):
    return secret_scan.learn(spark.read.parquet(f"{DIR}/documents.parquet"), "doc_id", F.col("text"))


def test_odd_secrets(spark, model):
    texts = ["secret=token: abcdefgh", "🙂 PassWord = 'hunter2!' x", "AKIA" + "A" * 16 + "AKIA" + "B" * 30, "a" * 24 + "g" + "b" * 23, "token token=abc.def-g", "api_key:'x' apikey=123456", "\uffff\uffff" + "0" * 40 + "\uffff", "", None]
    texts.append("key zQ8vK2mXw7Rt5LpJ9sYb4NfH3cGd end, internationalisation_of_everything_now and " + "-" * 40)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["id"]: r for r in secret_scan.scan(df, "doc_id", F.col("text"), model).collect()}
    for i, t in enumerate(texts):
        assert [(s["start"], s["kind"], s["end"]) for s in found[i]["base"]] == brute_spans(t), t
    added = [s["text"] for s in found[len(texts) - 1]["spans"] if s["kind"] == 3]
    assert added == ["zQ8vK2mXw7Rt5LpJ9sYb4NfH3cGd"]
    clean = {r["doc_id"]: r["text"] for r in secret_scan.clean(df, "text", model).collect()}
    assert clean[1] == "🙂 [SECRET]!' x" and clean[8] is None and clean[7] == "" and "zQ8" not in clean[9] and "internationalisation" in clean[9]


ALPHABETS = {"hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "lower": string.ascii_lowercase + string.digits, "upper": string.ascii_uppercase + string.digits, "base64": string.ascii_letters + string.digits + "+/", "url": string.ascii_letters + string.digits + "-_"}
USUAL = ["internationalisation_of_everything", "getUserAccountSettingsFromRequest", "MAX_CONNECTION_POOL_SIZE", "org/apache/spark/sql/functions", "articles/some-long-title-of-a-post", "4532015112830366", "20240115-093000", "test_shares_stay_within_a_block", "counterrevolutionaries", "-" * 40, "=" * 30, "_" * 20, "Donaudampfschifffahrtsgesellschaft", "kkkkkkkkkkkkkkkkkkkkkkkk", "0000000000000000000"]


def test_planted_random_tokens_are_found(spark, model):
    rng = random.Random(11)
    rows = [(f"{k} {n}", f"x {''.join(rng.choice(a) for _ in range(n))} y") for k, a in ALPHABETS.items() for n in (16, 20, 32, 48, 64) for _ in range(60)]
    found = secret_scan.scan(spark.createDataFrame(rows, "k string, text string"), "k", F.col("text"), model).groupBy("id").agg(F.avg((F.size("spans") > 0).cast("double")).alias("share")).collect()
    assert len(found) == 30 and all(r["share"] >= 0.9 for r in found), found
    usual = secret_scan.scan(spark.createDataFrame([(x, f"see {x}, {x}.") for x in USUAL], "k string, text string"), "k", F.col("text"), model)
    assert [r["id"] for r in usual.filter("size(spans) > 0").collect()] == []


def brute_ratio(model, token):
    kinds = [re.compile(p) for p in ("[0-9a-f]*", "[0-9A-F]*", "[0-9a-z]*", "[0-9A-Z]*", ".*")]
    table = model.ratios[next(i for i, p in enumerate(kinds) if p.fullmatch(token))]
    return sum(table[(ord(a) - ord("+")) * 80 + ord(b) - ord("+")] for a, b in zip(token, token[1:]))


def test_added_spans_by_brute_force(spark, model):
    rng = random.Random(5)
    every = "".join(ALPHABETS["base64"]) + "=_-"
    texts = []
    for _ in range(60):
        words = [rng.choice(USUAL + ["token = abcdef", "plain", "é🙂", "AKIA" + "Q7" * 9]) if rng.random() < 0.6 else "".join(rng.choice(rng.choice([every, "abc", "0123456789abcdef"])) for _ in range(rng.randrange(10, 40))) for _ in range(12)]
        texts.append(rng.choice([" ", ", ", "\n"]).join(words))
    for r in secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), "k", F.col("text"), model).collect():
        t = texts[r["id"]]
        want = brute_spans(t)
        blank = list(t)
        for a, _, b in want:
            blank[a:b] = " " * (b - a)
        want += [(m.start(), 3, m.end()) for m in re.finditer("[A-Za-z0-9+/_=-]{16,}", "".join(blank)) if brute_ratio(model, m[0]) >= model.least]
        assert [(s["start"], s["kind"], s["end"]) for s in r["spans"]] == sorted(want)


def test_redaction_by_brute_force(spark, model):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["ffffffffffffffffffffffffapi_key=xyz123", "token='abcdefgh'", "word 🙂", "AKIA" + "B" * 18, "a" * 30 + " secret=" + "c" * 40, "prose " * 900]) for _ in range(40)) for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["id"]: r["spans"] for r in secret_scan.scan(df, "doc_id", F.col("text"), model).collect()}
    for r in secret_scan.clean(df, "text", model).collect():
        t, out, at = texts[r["doc_id"]], "", 0
        for s in spans[r["doc_id"]]:
            if s["start"] >= at:
                out += t[at : s["start"]] + "[SECRET]"
            at = max(at, s["end"])
        assert r["text"] == out + t[at:]


def test_secrets_of_awkward_rows(spark):
    rows, empty = awkward(spark), spark.createDataFrame([], CLASHING)
    ratios = secret_scan.learn(rows, "doc_id", F.col("text"))
    assert secret_scan.scan(rows, "doc_id", F.col("text"), ratios).count() == rows.count()
    assert [r["spans"] for r in secret_scan.scan(rows, "doc_id", F.col("text"), ratios).filter("id = 2").collect()] == [[]]
    assert secret_scan.scan(empty, "doc_id", F.col("text"), secret_scan.learn(empty, "doc_id", F.col("text"))).count() == 0
    assert secret_scan.clean(rows, "text", ratios).columns == rows.columns


# ---- mixing

@pytest.mark.parametrize("weights", [{"a": 1, "b": 1}, {"a": 5, "b": 3, "c": 1, "d": 0.2}, {x: 1 for x in "abcdefghijk"}])
def test_shares_stay_within_a_block(weights):
    blocks = {s: 200 + 37 * i for i, s in enumerate(weights)}
    plan = source_mix.schedule(blocks, weights, 256)
    taken, given = {}, Counter()
    for s, a, b, start, frame, slots in plan:
        given[s] += b - a
        for k in range(b - a):
            taken[start + k // len(slots) * frame + slots[k % len(slots)]] = s
    assert given == blocks and sorted(taken) == list(range(sum(blocks.values())))
    for start in sorted({p[3] for p in plan}):
        share = {s: len(slots) / frame for s, _, _, st, frame, slots in plan if st == start}
        end = min((p[3] for p in plan if p[3] > start), default=len(taken))
        count = Counter()
        for t in range(start, end):
            count[taken[t]] += 1
            assert all(abs(count[s] - share[s] * (t + 1 - start)) < 1 for s in share)


@pytest.mark.parametrize("weights", [{f"s{i}": 1.0 for i in range(20)}, {f"s{i}": (i + 2) ** 0.5 for i in range(12)}, {"big": 1.0, "other": 0.7, "tiny": 1e-4}])
def test_real_weights_hold_over_many_frames(weights):
    taken = {}
    for s, a, b, start, frame, slots in source_mix.schedule({s: 40_000 for s in weights}, weights, 256):
        for k in range(b - a):
            taken[start + k // len(slots) * frame + slots[k % len(slots)]] = s
    assert sorted(taken) == list(range(40_000 * len(weights)))
    total, count = sum(weights.values()), Counter()
    for t in range(len(taken)):  # the first phase
        count[taken[t]] += 1
        assert all(abs(count[s] - w / total * (t + 1)) < 1 + 1e-6 for s, w in weights.items())
        if count[taken[t]] == 40_000:
            break


def test_mix_places_every_row_once(spark, docs):
    found = queries.op7_source_mix(spark, DIR).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(docs) and len({r["position"] for r in found}) == len(docs)
    assert all(r["source"] == docs[r["doc_id"]]["source"] for r in found)


def test_mix_of_awkward_rows(spark):
    rows, empty = awkward(spark), spark.createDataFrame([], CLASHING)
    found = source_mix.mix(rows, "doc_id", "source", block_rows=2).collect()
    assert len(found) == rows.count() == len({r["position"] for r in found})
    assert source_mix.mixed(rows, "doc_id", "source").columns == rows.columns and source_mix.mixed(rows, "doc_id", "source").count() == rows.count()
    assert source_mix.mix(empty, "doc_id", "source").count() == 0
    with pytest.raises(ValueError, match="no positive weight"):
        source_mix.mix(rows, "doc_id", "source", {"a": 1.0})


# ---- packing

def test_bounds_are_the_best(spark):
    rng = random.Random(3)
    from itertools import combinations

    for _ in range(20):
        lengths = [rng.randrange(1, 60) for _ in range(30)]
        found = Counter(lengths)
        bounds = packing.best_bounds(np.array(list(found)), np.array(list(found.values())), 4)
        cost = lambda bs: sum(next(b for b in bs if b >= n) - n for n in lengths)
        distinct = sorted(set(lengths))
        assert cost(bounds) == min(cost(c + (distinct[-1],)) for k in range(4) for c in combinations(distinct[:-1], k))


def test_packing_keeps_budget_and_rows(spark, docs):
    found = queries.op4_packing(spark, DIR).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(docs)
    batches = Counter((r["bucket"], r["batch"]) for r in found)
    for r in found:
        assert r["n_tokens"] == len(docs[r["doc_id"]]["text"].encode()) + 1 <= r["bucket_len"] and r["padding"] == r["bucket_len"] - r["n_tokens"]
        n = batches[r["bucket"], r["batch"]]
        assert (n * r["bucket_len"] <= 65536 or n == 1) and r["slot"] < n
    rows, empty = awkward(spark), spark.createDataFrame([], CLASHING)
    odd = packing.pack(rows, "doc_id", packing.byte_tokens(F.col("text")), 3, 1000).collect()
    assert len(odd) == rows.count() and len({(r["bucket"], r["batch"], r["slot"]) for r in odd}) == len(odd)
    assert packing.pack(empty, "doc_id", packing.byte_tokens(F.col("text"))).count() == 0


# ---- sharding

def test_shards(spark, docs):
    found = queries.op8_sharding(spark, DIR).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(docs) and {r["law"] for r in found} == {"bytes"}
    load, slots, groups = Counter(), {}, {}
    for r in found:
        data = docs[r["doc_id"]]["text"].encode()
        assert r["size"] == len(data) + 8 and r["text_crc32"] == zlib.crc32(data) and r["grown_shard"] is None
        load[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        groups.setdefault(data, set()).add(r["shard"])
    assert sorted(load) == list(range(24)) and max(load.values()) - min(load.values()) < 0.01 * max(load.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(g) == 1 for g in groups.values())


def test_many_alike_groups_fill_evenly():
    plan = sharding.longest_first([(7, 1000, 7.0), (9, 3, 9000.0), (1, 5, 0.0)], 4)
    load = Counter()
    for key, starts, shards in plan:
        n, mean = {7: (1000, 7.0), 9: (3, 9000.0), 1: (5, 0.0)}[key]
        for a, b, s in zip(starts, [*starts[1:], n], shards, strict=True):
            load[s] += (b - a) * mean
    assert sum(load.values()) == 34000 and max(load.values()) == 9000


def heap_shards(sizes: list[int], shards: int) -> int:
    load = [0] * shards
    for n in sorted(sizes, reverse=True):
        load[load.index(min(load))] += n
    return max(load)


def test_as_even_as_a_plain_heap(spark):
    """Large groups of sizes that one bin would hold, beside many small ones."""
    rng = random.Random(8)
    texts = [f"{i} " + "x" * rng.choice([rng.randrange(40), 40_000 + rng.randrange(60), rng.randrange(9000)]) for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    load = Counter()
    for r in sharding.shard_rows(df, "doc_id", F.col("text"), 7).collect():
        load[r["shard"]] += r["size"]
    assert max(load.values()) <= heap_shards([len(t) + 8 for t in texts], 7) * 1.0005


def test_one_group_of_a_third(spark):
    rows = [(i, "the same text") for i in range(400)] + [(1000 + i, f"text {i}") for i in range(800)]
    found = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", F.col("text"), 4).collect()
    assert len(found) == 1200 and len({r["shard"] for r in found if r["id"] < 1000}) == 1


def test_shards_of_awkward_rows(spark):
    rows, empty = awkward(spark), spark.createDataFrame([], CLASHING)
    found = sharding.shard_rows(rows, "doc_id", F.col("text"), 3).collect()
    by = {r["id"]: r["shard"] for r in found}
    assert len(found) == rows.count() and by[1] == by[5] and by[2] == by[3]
    assert len({(r["shard"], r["slot"]) for r in found}) == len(found)
    assert sharding.shard_rows(empty, "doc_id", F.col("text")).count() == 0


# ---- media

def png(width=3, height=2):
    import struct

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * (width + 1) * height)) + chunk(b"IEND", b"")


GIF = b"GIF89a" + bytes([1, 0, 1, 0, 0x80, 0, 0]) + bytes(6) + b"\x21\xf9\x04\0\0\0\0\0" + b"\x2c" + bytes([0, 0, 0, 0, 1, 0, 1, 0, 0]) + b"\x02\x02\x44\x01\0" + b"\x3b"
JPEG = b"\xff\xd8\xff\xe0\x00\x10JFIF\0\x01\x01\0\0\x01\0\x01\0\0" + b"\xff\xda\x00\x04ab" + b"scan\xff\x00more\xff\xd0x" + b"\xff\xd9"


def test_sniffing_carves_whole_media_only():
    magic = media.automaton()
    whole = [png(), GIF, JPEG, media.wav(b"\x80" * 10)]
    kinds = ["image/png", "image/gif", "image/jpeg", "audio/wav"]
    for data, kind in zip(whole, kinds, strict=True):
        assert media.sniff(data, "text/plain", magic)[0] == kind
        assert media.sniff(data[:-1], "text/plain", magic)[0] == "text/plain"
        inside = b"junk GIF89a RIFF " + data + b" tail " + data
        _, found, _ = media.sniff(inside, None, magic)
        assert [(k, inside[a:b]) for k, a, b in found] == [(kind, data)] * 2
    broken = bytearray(png())
    broken[20] ^= 1
    assert media.sniff(bytes(broken), None, magic)[0] == media.OCTETS


def test_sniffed_columns(spark):
    df = spark.createDataFrame([(1, bytearray(png()), "image/jpeg"), (2, None, "x"), (3, bytearray(b""), None), (4, bytearray(b"GIF89a no"), None), (5, bytearray(b"..." + GIF), "text/html")], "id long, blob binary, declared string")
    by = {r["id"]: r for r in media.sniff_media(df, "id", F.col("blob"), F.col("declared")).collect()}
    assert [by[i]["type"] for i in range(1, 6)] == ["image/png", media.EMPTY, media.EMPTY, media.OCTETS, "text/html"]
    assert bytes(by[5]["carved"][0]) == GIF and by[5]["embedded"][0]["start"] == 3


def test_texts_are_stored_whole(spark, docs):
    def want(text):
        data = (text or "").encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(payload) + 44, hashlib.sha256(media.wav(payload)).hexdigest()

    for r in queries.op9_media(spark, DIR).collect():
        assert tuple(r)[1:7] == want(docs[r["doc_id"]]["text"]) and r["feature"].startswith("type=audio/wav;")
    rows = awkward(spark)
    found = media.store_text(rows, "doc_id", F.col("text")).collect()
    assert len(found) == rows.count() and sorted(tuple(r)[1:7] for r in found) == sorted(want(r["text"]) for r in rows.collect())
    assert media.store_text(spark.createDataFrame([], CLASHING), "doc_id", F.col("text")).count() == 0


def test_near_duplicates_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    want = con.sql(f"SELECT doc_id, n_shingles, component_id, kept FROM ({queries.NEAR_SQL})").fetchall()
    assert sorted(tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "kept")) for r in queries.op5_near_dedup(spark, DIR).collect()) == sorted(want)


def test_shared_counts():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(1, 4000))) for _ in range(30)]
    left, right = np.arange(0, 14), np.arange(14, 30)
    want = [[len(np.intersect1d(sets[i], sets[j])) for j in right] for i in left]
    assert near_dedup.shared_counts(sets, left, right).tolist() == want


def hovering(n: int, changed: int = 4) -> list[tuple[int, str]]:
    """Copies of 200 words, each with a few of them changed: most pairs are a little under the threshold, some over it."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(n):
        words = list(base)
        for at in rng.sample(range(200), changed):
            words[at] = f"edit{k}x{at}"
        rows.append((k, " ".join(words)))
    return rows


def test_a_group_that_hovers_about_the_threshold(spark, monkeypatch):
    rows = hovering(250)
    want = near_groups(rows)
    assert len(set(want.values())) > 20
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (512, 40):
        monkeypatch.setattr(near_dedup, "BLOCK_ROWS", block)
        found = near_dedup.near_duplicates(df, "doc_id", F.col("text")).collect()
        assert {r["id"]: r["component_id"] for r in found} == want


def test_three_thousand_hovering_classes(spark):
    """What hovers is judged once for each two blocks: the test ends in time, and agrees with the product of all sets."""
    rows = hovering(3000, 5)
    sets = [np.array(sorted(hash(x) for x in shingles(t))) for _, t in rows]
    every = np.arange(len(sets))
    both = near_dedup.shared_counts(sets, every, every)
    n = np.array([len(s) for s in sets])
    u, v = np.nonzero(100 * both >= 75 * (n[:, None] + n[None, :] - both))
    root = common.united(len(sets), u, v)
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), "doc_id", F.col("text")).collect()
    assert {r["id"]: r["component_id"] for r in found} == dict(enumerate(root.tolist()))


def test_the_drivers_steps_do_not_grow_with_the_rows():
    """Three million blocks: a row of the plan for each source and phase, and each source's share is less than a block off at every slot."""
    sizes = {"a": 30_000_000, "b": 11_000_000, "c": 7_000_000, "d": 48_000}
    weights = source_mix.targets(sizes)
    blocks = {s: -(-n // 16) for s, n in sizes.items()}
    plan = source_mix.schedule(blocks, weights)
    assert len(plan) <= len(sizes) ** 2 and sum(b - a for _, a, b, *_ in plan) == sum(blocks.values()) and abs(sum(weights.values()) - 1024) <= 8
    first = [p for p in plan if p[3] == 0]
    total = sum(weights.values())
    for s, a, b, start, frame, slots in first:
        at = np.arange(b - a)
        slot = start + at // len(slots) * frame + np.array(slots)[at % len(slots)]
        due = slot * weights[s] / total
        assert (np.diff(slot) > 0).all() and (at - due < 1).all() and (at + 1 - (slot + 1) * weights[s] / total > -1).all()


def test_secret_models_learn_from_every_document(spark):
    """What only the last of many documents has changes the models, and the threshold is what few ordinary tokens reach."""
    usual = [(i, "plain words about the weather and the sea") for i in range(5000)]
    learned = lambda last: secret_scan.learn(spark.createDataFrame([*usual, *((5000 + i, last) for i in range(3))], "k long, text string"), "k", F.col("text"))
    assert learned("qzjx " * 4000).ratios != learned("plain words").ratios
    judged = spark.createDataFrame([(float(i),) for i in range(1000)], "ratio double")
    for share in (0.0, 0.01, 0.3):
        least = secret_scan.threshold(judged, 24.0, share)
        assert 0.99 * 1000 * share - 5 <= judged.filter(f"ratio >= {least}").count() <= 1000 * share
    assert secret_scan.threshold(judged, 24.0, 0.99) == 24.0
