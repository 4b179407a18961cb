"""Language, toxicity, quality and URL rules: held-out accuracy, brute force, awkward rows."""

import math
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightwake.llm import language_id, quality_rules, queries, toxicity, url_rules

from .helpers import CLASHING, awkward, crc

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


def test_language_held_out(spark, docs):
    found = queries.op1_language_id(spark, DIR).collect()
    assert len(found) == len(docs)
    assert all(r["held_out"] == (crc(r["doc_id"]) % 3 == 1) and 0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) / len(held) > 0.98


def brute_code_length(trees: language_id.Trees, counts: dict, lang: str, text: bytes) -> float:
    """Straight from the definition, byte by byte."""
    data, bits = b"\n\n\n" + text, 0.0
    for i in range(3, len(data)):
        for k in range(3, -1, -1):
            context = data[i - k : i]
            known = counts.get((lang, context), {})
            total, distinct = sum(known.values()), len(known)
            if data[i] in known:
                bits -= math.log2(known[data[i]] / (total + distinct))
                break
            if known:
                bits -= math.log2(distinct / (total + distinct))
        else:
            bits += 8.0
    return bits


def test_code_lengths_are_those_of_the_definition():
    train = {"x": b"abab abba cab dabba", "y": b"zyx xyz zzyx yx"}
    rows, counts = [], {}
    for lang, text in train.items():
        data = b"\n\n\n" + text
        for i in range(3, len(data)):
            for k in range(4):
                counts.setdefault((lang, data[i - k : i]), {}).setdefault(data[i], 0)
                counts[lang, data[i - k : i]][data[i]] += 1
    for (lang, context), after in counts.items():
        for b, n in after.items():
            rows.append((lang, len(context) + 1, int.from_bytes(context + bytes([b]), "big"), n))
    trees = language_id.Trees(*(np.array(c, dtype=object if i == 0 else np.int64) for i, c in enumerate(zip(*rows, strict=True))))
    texts = [b"abba zyx", b"", b"q", b"cab\n\ndab", bytes(range(256))]
    padded = [b"\n\n\n" + t for t in texts]
    data, offsets = np.frombuffer(b"".join(padded), np.uint8), np.cumsum([0] + [len(p) for p in padded])
    for window in (1 << 19, 7):
        got = trees.lengths(data, offsets, window) / language_id.UNITS
        for m, lang in enumerate(trees.langs):
            for j, t in enumerate(texts):
                assert got[m, j] == pytest.approx(brute_code_length(trees, counts, lang, t), abs=0.01 * (len(t) + 1))


def test_language_of_awkward_rows(spark):
    rows = awkward(spark)
    trees = language_id.learn(rows, "doc_id", "lang", F.col("text"))
    found = language_id.predict(rows, "doc_id", F.col("text"), trees).collect()
    by = {r["id"]: r["lang"] for r in found}
    assert len(found) == rows.count() and by[2] == by[3] == by[4] == "und" and by[7] in ("de", "en")
    empty = spark.createDataFrame([], CLASHING)
    assert language_id.learn(empty, "doc_id", "lang", F.col("text")) is None
    assert {r["lang"] for r in language_id.predict(rows, "doc_id", F.col("text"), None).collect()} == {"und"}
    assert language_id.predict(empty, "doc_id", F.col("text"), trees).count() == 0


def test_toxicity_held_out(spark):
    found = {r["doc_id"]: r for r in queries.op10_toxicity(spark, DIR).collect()}
    labels = spark.read.parquet(f"{DIR}/labels.parquet").collect()
    assert all(r["held_out"] == (crc(i) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in found.items())
    held = [(r["toxic"], found[r["doc_id"]]["predicted"]) for r in labels if found[r["doc_id"]]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.93


def test_toxicity_of_awkward_rows(spark):
    rows = awkward(spark)
    labels = spark.createDataFrame([(1, 0), (5, 0), (6, 1), (7, 1), (8, 0), (9, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    fitted = toxicity.learn(rows, labels, "doc_id", "toxic", F.col("text"))
    found = toxicity.score(rows, "doc_id", F.col("text"), fitted).collect()
    assert len(found) == rows.count() and all(0 <= r["score"] <= 1 for r in found)
    for few, want in ((labels.filter("toxic = 1"), 1.0), (labels.filter("toxic = 0"), 0.0), (labels.limit(0), 0.0)):
        one = toxicity.score(rows, "doc_id", F.col("text"), toxicity.learn(rows, few, "doc_id", "toxic", F.col("text"))).first()["score"]
        assert one == pytest.approx(want, abs=1e-9)
    assert toxicity.score(spark.createDataFrame([], CLASHING), "doc_id", F.col("text"), fitted).count() == 0


def test_features_are_found_across_windows():
    def points(t):
        return toxicity.characters(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]

    code = np.unique(np.concatenate([toxicity.grams(points("idiót".encode()), s) for s in toxicity.SIZES]))
    lexicon = toxicity.Lexicon(code)
    texts = [" an IDIóT idiót ".encode(), b" none ", b"idi", "ót idi".encode(), "漢字idi".encode()]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    want = sorted((r, f) for r, t in enumerate(texts) for f, g in enumerate(code) if any(toxicity.grams(points(t.lower()), s).tolist().count(int(g)) for s in toxicity.SIZES))
    for window in (5, 1 << 19):
        assert sorted(zip(*(x.tolist() for x in lexicon.find(data, offsets, window)), strict=True)) == want


def brute_measures(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for v in seen.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_and_labels(spark, docs):
    found = queries.op6_quality_rules(spark, DIR).collect()
    assert len(found) == len(docs)
    for r in found:
        want = brute_measures(docs[r["doc_id"]]["text"])
        assert tuple(r)[1:6] == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r["base_failed"] and r["kept"])
    kept = {r["doc_id"]: r["kept"] for r in found}
    labels = [(r["quality"], kept[r["doc_id"]]) for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()]
    assert sum(k for q, k in labels if q == 0) <= 0.05 * len(labels) and sum(not k for q, k in labels if q == 1) <= 0.05 * len(labels)


def test_quality_of_awkward_rows(spark):
    rows = awkward(spark)
    found = quality_rules.judge(rows, "doc_id", F.col("text")).collect()
    assert len(found) == rows.count() and all(0 <= r["good"] <= 1 for r in found)
    assert quality_rules.judge(spark.createDataFrame([], CLASHING), "doc_id", F.col("text")).count() == 0
    texts = ["a b c d e f g h a b c d e f g h", "a b c d e f g h i a b c d e f g h", "x " * 40, "one\none\n \n \none", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.measures(df, F.col("text"), {"id": F.col("doc_id")}).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_measures(texts[r["id"]])


def plain_em(patterns, rules):
    """The same model, text by text."""
    rows = [p for p, n in patterns.items() for _ in range(n)]
    good = [1 / (p.count(1) + 1) if 1 in p else 0.98 for p in rows]
    for _ in range(500):
        says, shares = {}, {}
        for kind, start in (("good", 0.9), ("junk", 0.5)):
            w = good if kind == "good" else [1 - g for g in good]
            shares[kind] = (sum(w) + 1) / (len(rows) + 2)
            says[kind] = [(sum(x for x, p in zip(w, rows) if p[j] == 2) + 2 * start) / (sum(x for x, p in zip(w, rows) if p[j]) + 2) for j in range(rules)]

        def odds(p):
            out = math.log(shares["good"] / shares["junk"])
            for j, v in enumerate(p):
                if v:
                    a, b = says["good"][j], says["junk"][j]
                    out += math.log(a / b) if v == 2 else math.log((1 - a) / (1 - b))
            return out

        now = [1 / (1 + math.exp(-odds(p))) for p in rows]
        moved, good = max(abs(x - y) for x, y in zip(now, good)), now
        if moved < 1e-7:
            break
    return dict(zip(rows, good))


def test_posteriors_are_those_of_a_plain_em():
    rng = np.random.default_rng(2)
    patterns = {}
    for _ in range(800):
        junk = rng.random() < 0.2
        p = tuple(0 if rng.random() < 0.2 else 1 + int(rng.random() < (0.4 if junk else 0.93)) for _ in range(5))
        patterns[p] = patterns.get(p, 0) + 1
    found, want = quality_rules.Estimates(5).fit(patterns), plain_em(patterns, 5)
    assert all(found.posterior(p) == pytest.approx(want[p], abs=1e-4) for p in patterns)


def test_an_unreliable_rule_is_outvoted_and_two_that_agree_reject():
    """The last rule finds fault with a tenth of everything; the others agree on junk."""
    patterns = {(2, 2, 2, 2): 800, (2, 2, 2, 1): 90, (1, 1, 2, 2): 60, (1, 1, 1, 2): 40, (1, 1, 2, 1): 12, (2, 1, 1, 2): 30}
    found = quality_rules.Estimates(4).fit(patterns)
    assert found.posterior((2, 2, 2, 1)) > 0.5 and found.posterior((1, 1, 2, 2)) < 0.5 and found.posterior((2, 1, 1, 2)) < 0.5
    assert found.posterior((2, 2, 2, 2)) > 0.95
    assert quality_rules.Estimates(3).fit({}).shares["good"] == 0.85


def test_the_posterior_decides_not_the_rules_one_by_one(spark):
    """No set of rules that must all pass keeps the same texts; the labels are met better than by demanding all."""
    rows = quality_rules.judge(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), "doc_id", F.col("text")).filter(~quality_rules.base_failed())
    votes = [f"vote_{k}" for k in quality_rules.rules()]
    found = rows.select("id", "good", *votes).collect()
    outvoted = [r for r in found if r["good"] >= 0.5 and any(r[v] == quality_rules.JUNK for v in votes)]
    assert len(outvoted) > 50
    vetoed = {v for r in outvoted for v in votes if r[v] == quality_rules.JUNK}
    left = [v for v in votes if v not in vetoed]  # the rules that a conjunction could hold
    assert any(r["good"] < 0.5 and all(r[v] != quality_rules.JUNK for v in left) for r in found) or len(vetoed) >= 2
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    right = sum((r["good"] >= 0.5) == bool(labels[r["id"]]) for r in found if r["id"] in labels)
    all_pass = sum(all(r[v] != quality_rules.JUNK for v in votes) == bool(labels[r["id"]]) for r in found if r["id"] in labels)
    assert right > all_pass


def test_only_good_rows_stay_whole(spark):
    rows = awkward(spark)
    assert quality_rules.only_good(rows, F.col("text")).columns == rows.columns
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    want = {r["id"] for r in quality_rules.judge(docs, "doc_id", F.col("text")).filter(quality_rules.kept()).collect()}
    got = quality_rules.only_good(docs, F.col("text")).collect()
    assert {r["doc_id"] for r in got} == want and len(got) == len(want) and got[0]["text"]


def brute_url(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = re.split("[?#]", rest[end:])[0]
    fits = [r for r in queries.URL_RULES if (lambda h, p: (host == h or host.endswith("." + h)) and path.startswith(p))(r.split("/")[0], r[r.index("/") :])]
    return host, path, max(fits, key=len, default=None)


def test_url_rules(spark):
    odd = [(-1, None, ""), (-2, "", ""), (-3, "nothing here", ""), (-4, "HTTP://A.Example.NET/en/x?q#z", ""), (-5, "http://net", ""), (-6, "http://net/", ""), (-7, "x://y://z.net/a", ""), (-8, "http://planet/", ""), (-9, "http://ÄB.Org/fr/1#?", ""), (-9, "http://ÄB.Org/fr/1#?", ""), (None, "http://www.casino-win.example.org/en", ""), (-10, "http://long.example.org/" + "part/" * 20_000, "")]
    plain = spark.read.parquet(f"{DIR}/pages.parquet")
    pages = spark.createDataFrame(odd, "page_id long, url string, host string").unionByName(plain.select("page_id", "url", F.lit("").alias("host")))
    labels = url_rules.labelled(plain, "page_id", "url", "html", queries.URL_RULES)
    found = url_rules.judge(pages, "page_id", "url", queries.URL_RULES, labels)
    rows = found.join(pages.select(F.col("page_id").alias("id"), "url").distinct(), "id").collect()
    assert rows
    for r in rows:
        host, path, rule = brute_url(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == queries.URL_RULES[rule] if rule else r["verdict"] in ("allow", "block")
    assert found.count() == pages.count() and {r["label"] for r in labels.collect()} <= {"allow", "block", None}
    empty = url_rules.judge(pages.limit(0), "page_id", "url", queries.URL_RULES, labels.limit(0))
    assert empty.count() == 0 and url_rules.labelled(plain.limit(0), "page_id", "url", "html", {}).count() == 0


def brute_tokens(url):
    host, path, _ = brute_url(url)
    words = [f"h:{w}" for w in re.split("[.-]", host)] + [f"p:{re.sub('[0-9]+', '#', w.lower())}" for w in path.split("/")]
    return frozenset(t for t in words if len(t) > 2)


def brute_mine(baskets, support, confidence):
    """All subsets of all baskets, counted; then those that no shorter one implies."""
    total = len(baskets)
    often = {t for t, n in Counter(t for ts, _ in baskets for t in ts).items() if n <= 0.9 * total}
    have, said = Counter(), Counter()
    for ts, label in baskets:
        for k in range(1, len(ts & often) + 1):
            for part in combinations(sorted(ts & often), k):
                have[part] += 1
                said[part, label] += 1
    rules = {(p, label): (n / have[p], n / total) for (p, label), n in said.items() if label and n / have[p] >= confidence and n >= math.ceil(support * total)}
    return {(p, label): c for (p, label), c in rules.items() if not any((q, label) in rules and rules[q, label][0] >= c[0] for k in range(1, len(p)) for q in combinations(p, k))}


def test_mined_rules_and_verdicts_by_brute_force(spark):
    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    labels = url_rules.labelled(pages, "page_id", "url", "html", queries.URL_RULES)
    baskets = [(brute_tokens(r["url"]), r["label"]) for r in labels.collect()]
    rules = brute_mine(baskets, 0.03, 0.9)
    found = {r["id"]: r["verdict"] for r in url_rules.judge(pages, "page_id", "url", queries.URL_RULES, labels, 0.03).collect()}
    assert rules
    for r in pages.collect():
        rule, mine = brute_url(r["url"])[2], brute_tokens(r["url"])
        fits = [(round(c, 9), round(n, 9), label, p) for (p, label), (c, n) in rules.items() if set(p) <= mine]
        assert found[r["page_id"]] == (queries.URL_RULES[rule] if rule else max(fits)[2] if fits else "allow")


def page(words):
    return "<html><head><title>t</title></head><body>" + "".join(f"<p>{w}</p>" for w in words) + "</body></html>"


def test_rules_from_what_pages_say_block_and_spare(spark):
    """One shop's pages are junk, except for its help; no listed rule covers any of them."""
    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(list("abcdefghilmnoprstu"), rng.integers(3, 8))) for _ in range(400)]
    prose = lambda: page([" ".join(rng.choice(vocabulary, 14)).capitalize() + "." for _ in range(9)])
    junk = lambda: page([" ".join(f"{w.upper()}$$$!!" for w in rng.choice(vocabulary, 6)) for _ in range(20)])
    rows = [(i, f"https://w{i % 7}.trade.example/buy/{i}", junk()) for i in range(90)]
    rows += [(100 + i, f"https://w{i % 7}.trade.example/help/{i}", prose()) for i in range(60)]
    rows += [(200 + i, f"https://paper{i % 9}.example/news/{i}", prose()) for i in range(250)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    labels = url_rules.labelled(pages, "page_id", "url", "html", queries.URL_RULES)
    new = spark.createDataFrame([(1, "https://w3.trade.example/buy/99999"), (2, "https://w3.trade.example/help/77"), (3, "https://paper2.example/news/x")], "page_id long, url string")
    found = {r["id"]: r for r in url_rules.judge(new, "page_id", "url", queries.URL_RULES, labels, 0.02).collect()}
    assert [found[i]["verdict"] for i in (1, 2, 3)] == ["block", "allow", "allow"] and all(r["rule"] is None and r["mined_items"] for r in found.values())


def test_mined_rules_have_their_confidence(spark):
    rows = [(["h:a", "h:x"], "block")] * 30 + [(["h:a", "h:y"], None)] * 30 + [(["h:b"], "allow")] * 20
    df = spark.createDataFrame(rows, "tokens array<string>, label string")
    rules = {tuple(r["items"]): r for r in url_rules.mine(df, 0.05, 0.9)}
    assert set(rules) == {("h:x",), ("h:b",)} and rules["h:x",]["confidence"] == 1.0 and rules["h:x",]["support"] == 0.375


def test_no_rule_is_cut(spark):
    """A path of 11 constant parts makes 2,047 raw rules, beside 2,100 short ones; a longer one of less confidence stays all the same."""
    path, more = [f"p:{i}" for i in range(11)], [f"q:{i}" for i in range(2100)]
    rows = [(path, "block")] * 40 + [([q], "block") for q in more] + [(["h:a", "h:b"], "allow")] * 29 + [(["h:a", "h:b"], None)] + [(["h:a"], None)] * 30 + [(["h:b"], None)] * 30
    rules = {tuple(r["items"]): r["label"] for r in url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), 0.0004, 0.9)}
    assert rules == {(p,): "block" for p in path + more} | {("h:a", "h:b"): "allow"}


def test_long_urls_are_mined_in_time(spark):
    """Twenty URLs of 60 parts of their own, and a template of 30 nested parts: neither makes subsets of them all."""
    import time

    rows = [([f"p:{k}x{i}" for i in range(60)] + ["h:a"], "block" if k % 2 else "allow") for k in range(20)]
    rows += [([f"n:{i}" for i in range(1 + k % 30)] + ["h:b"], "block" if k % 30 > 20 else None) for k in range(300)]
    df = spark.createDataFrame(rows, "tokens array<string>, label string")
    began = time.perf_counter()
    rules, names = url_rules.rule_table(df, 0.001, 0.9)
    found = {tuple(r["items"]): r for r in rules.collect()}
    assert time.perf_counter() - began < 60
    # Whoever has part 21 has all before it, and is blocked; no longer rule says more.
    assert found["n:21",]["label"] == "block" and found["n:21",]["confidence"] == 1.0 and round(found["n:21",]["support"], 6) == round(90 / 320, 6)
    assert not any(len(p) > 1 for p in found if all(x.startswith("n:") for x in p))
    reps = {r["item"] for r in names.filter("t like 'p:%'").collect()}
    assert len(reps) == 20 and all((r,) in found for r in reps)


def test_wide_urls_are_counted_exactly(spark, monkeypatch):
    """With few items to combine, what is proposed has the figures of all items."""
    rng = np.random.default_rng(3)
    baskets = [(frozenset(f"t{i}" for i in range(9) if rng.random() < 0.4), ["allow", "block", None][rng.integers(3)]) for _ in range(120)]
    baskets = [(b | {"t0"}, "block") if "t1" in b and "t2" in b else (b, label) for b, label in baskets]
    every = brute_mine(baskets, 0.03, 0.9)
    monkeypatch.setattr(url_rules, "WIDE", 4)
    df = spark.createDataFrame([(sorted(b), label) for b, label in baskets], "tokens array<string>, label string")
    found = {(tuple(r["items"]), r["label"]): (r["confidence"], r["support"]) for r in url_rules.mine(df, 0.03, 0.9)}
    have = lambda p: [label for b, label in baskets if set(p) <= b]
    for (p, label), (confidence, support) in found.items():
        assert abs(confidence - have(p).count(label) / len(have(p))) < 1e-8 and abs(support - have(p).count(label) / 120) < 1e-8
    assert found and {k for k in every if len(k[0]) == 1} <= set(found)


def test_wide_urls_lose_no_rule(spark, monkeypatch):
    """Two items that are a rule only together, in URLs of fourteen items whose others are purer; and all rules are those of brute force."""
    rng = np.random.default_rng(8)
    pure = [([f"s{k}"], "block") for k in range(12) for _ in range(5)]
    rows = pure + [(["a", "b", *(f"s{k}" for k in range(12) if k != j % 12)], "block") for j in range(12)] + [(["a"], None)] * 80 + [(["b"], None)] * 80 + [([f"s{k}"], None) for k in range(12)]
    df = spark.createDataFrame(rows, "tokens array<string>, label string")
    assert url_rules.WIDE < 13
    rules = {(tuple(r["items"]), r["label"]): r["confidence"] for r in url_rules.mine(df, 0.04, 0.97)}
    assert rules[("a", "b"), "block"] == 1.0
    assert rules == {p: round(c[0], 9) for p, c in brute_mine([(frozenset(ts), label) for ts, label in rows], 0.04, 0.97).items()}
    monkeypatch.setattr(url_rules, "WIDE", 3)
    for confidence in (0.5, 0.9):
        baskets = [(frozenset(f"t{i}" for i in range(9) if rng.random() < 0.5), ["allow", "block", None][rng.integers(3)]) for _ in range(150)]
        baskets = [(b, "block") if {"t1", "t4", "t7"} <= b else (b, label) for b, label in baskets]
        df = spark.createDataFrame([(sorted(b), label) for b, label in baskets], "tokens array<string>, label string")
        found = {(tuple(r["items"]), r["label"]): (r["confidence"], r["support"]) for r in url_rules.mine(df, 0.03, confidence)}
        assert found == {p: (round(c, 9), round(n, 9)) for p, (c, n) in brute_mine(baskets, 0.03, confidence).items()} and max(len(p) for p, _ in found) > 2


def test_many_languages_keep_few_tables(monkeypatch):
    """Two hundred languages of words of their own: sums don't depend on how many tables are kept, and what is sent grows with the trees."""
    import pickle

    dice = np.random.default_rng(4)
    rows, texts = [], []
    for i in range(200):
        text = language_id.PAD.encode() + bytes(dice.integers(97 + i % 20, 103 + i % 20, 400).astype(np.uint8))
        texts.append(text)
        for k in range(1, language_id.ORDER + 2):
            grams, n = np.unique([int.from_bytes(text[p - k + 1 : p + 1], "big") for p in range(language_id.ORDER, len(text))], return_counts=True)
            rows += [(f"l{i:03}", k, int(g), int(c)) for g, c in zip(grams, n, strict=True)]
    trees = language_id.Trees(*(np.array(c, dtype=object if i == 0 else np.int64) for i, c in enumerate(zip(*rows, strict=True))))
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    whole = trees.lengths(data, offsets)
    assert len(trees.made) == 200 and (whole.argmin(axis=0) == np.arange(200)).mean() == 1
    sent = pickle.dumps(trees)
    assert len(pickle.dumps(trees.own)) < 24 * len(rows)
    monkeypatch.setattr(language_id, "TABLE_BYTES", 1)
    again = pickle.loads(sent)
    assert not again.made and (again.lengths(data, offsets, window=5000) == whole).all() and len(again.made) == 1
