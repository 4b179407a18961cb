"""Small tables with every awkward case, and plain-Python forms of what the operators compute."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names an operator may use itself.
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, id long, kept boolean, rank long, `group` string, data string, score double, node long, position long, key string, `count` long, row long, part long, first long, base string, spans string, plain string, whole string, tokens string, __hash long, __id long, __position long"


def awkward(spark, schema: str = CLASHING):
    """Nulls in each column, empty and white texts, one long text, repeated rows, ties."""
    long_text = " ".join(f"word{i % 997} and{i % 13}" for i in range(30_000))
    rows = [
        (1, "one two three four five six seven eight nine ten eleven", "en", "a", 55), (2, None, "en", "a", None), (3, "", "fr", None, 0), (4, " \t\n", None, "b", 3), (None, "text without an id, of some length", "en", "b", 1),
        (5, "one two three four five six seven eight nine ten eleven", "en", "a", 55), (6, long_text, "de", "c", len(long_text)), (7, "ÄÖÜ straße ünïcode ﬃ 漢字 🙂", "de", "c", 1), (8, "short", "en", "a", 5), (8, "short", "en", "a", 5), (9, "\uffff token = \"abc123def456\" \uffff", "en", "a", 9),
    ]
    width = len(schema.split(",")) - 5
    return spark.createDataFrame([r + (None,) * width for r in rows], schema)


def crc(doc_id) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def shingles(text: str | None) -> frozenset:
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def near_groups(docs: list[tuple[int, str]]) -> dict[int, int]:
    """doc_id to the smallest id reachable, over all pairs."""
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    for i, s in sets.items():
        shared = defaultdict(int)
        for x in s:
            for j in by[x]:
                if j < i:
                    shared[j] += 1
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}
