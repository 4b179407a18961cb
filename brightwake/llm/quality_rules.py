"""Quality rules: weak supervision.

Each rule looks at one measure of a text and votes junk, votes good, or abstains. The bounds are rules of thumb, each
of them wrong about some texts. Expectation-maximisation over the table of vote patterns estimates, without labels, how
often each rule votes good on good texts and on junk (its accuracies); the posterior probability of good replaces the
demand that a text pass every rule. A junk vote of one rule alone is mostly outvoted, two that agree mostly aren't, and
how much each vote weighs is learned. The pattern table has at most 3 ** (number of rules) rows, whatever the
corpus; some hundreds occur.

All measures are SQL functions over whole texts. Defined results: a null text has no words; the measures of
an empty text are 0; an empty table keeps the starting estimates. Very long texts are read whole; equal texts have equal
votes, so rows that repeat share a verdict; a posterior of exactly one half keeps the text.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, quoted

SPACE = r"\x20\x09-\x0D"
WINDOW = 8
ABSTAIN, JUNK, GOOD = 0, 1, 2


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where a lambda reads it for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def left_of(text: Column, dropped: str) -> Column:
    """Number of characters outside the pattern."""
    return F.length(F.regexp_replace(text, dropped, "")).cast("long")


def repeat_words(words: Column) -> Column:
    """Words inside windows of eight words that occur twice or more; windows are compared by 64-bit hashes."""

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(WINDOW))))

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - s, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def repeated(w: Column) -> Column:
        placed = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(p: Column) -> Column:
            same = F.transform(p, lambda x, k: F.when((x["h"] == F.get(p, k - 1)["h"]) | (x["h"] == F.get(p, k + 1)["h"]), x["i"]))
            return F.array_sort(F.filter(same, lambda i: i.isNotNull()))

        starts = let(placed, twice)
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(let(starts, covered))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(let(let(hashes, windows), repeated))


def measured(text: Column) -> dict[str, Column]:
    """The measures of a text; the cut words and lines are columns of their own, so that each is cut once."""
    n = lambda c: F.size(c).cast("long")
    words, lines = F.col("words"), F.col("lines")
    return {
        "text_hash": F.xxhash64(text),
        "n_words": n(words),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": left_of(text, r"[^#*$%&|<>]+"),
        "n_lines": n(lines),
        "n_dup_lines": n(lines) - n(F.array_distinct(lines)),
        "n_repeat_words": repeat_words(words),
        "n_distinct": n(F.array_distinct(words)),
        "n_upper": left_of(text, r"\P{Lu}+"),
        "n_letters": left_of(text, r"\P{L}+"),
        "n_bangs": left_of(text, r"[^!]+"),
        "n_ends": left_of(text, r"[^.?…。]+"),
        "n_bare": F.regexp_count(text, F.lit(rf"(?<![^{SPACE}])[^\p{{L}}{SPACE}]+(?![^{SPACE}])")).cast("long"),
    }


def measures(df: DataFrame, text: Column, along: dict[str, Column]) -> DataFrame:
    """Per row: the columns ``along``, text_hash and the measures."""
    plain = df.select(*(c.alias(name) for name, c in along.items()), F.coalesce(text, F.lit("")).alias("text"))
    cut = plain.select(
        *along,
        "text",
        F.filter(F.split("text", f"[{SPACE}]+"), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("lines"),
    )
    return cut.select(*along, *(c.alias(name) for name, c in measured(F.col("text")).items()))


def share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def vote(junk: Column, good: Column) -> Column:
    return F.when(junk, JUNK).when(good, GOOD).otherwise(ABSTAIN)


def rules() -> dict[str, Column]:
    """Each rule's vote, by its measure; what lies between the two bounds abstains."""
    words, some = F.col("n_words"), F.col("n_words") >= 20
    return {
        "length": vote(words < 20, words >= 50),
        "word_length": vote((share("word_chars", "n_words") < 3) | (share("word_chars", "n_words") > 7), share("word_chars", "n_words").between(4, 6)),
        "symbols": vote(share("n_symbols", "n_words") > 0.1, share("n_symbols", "n_words") < 0.02),
        "letters": vote(share("n_letters", "word_chars") < 0.9, share("n_letters", "word_chars") > 0.94),
        "bare_words": vote(share("n_bare", "n_words") > 0.15, share("n_bare", "n_words") < 0.02),
        "sentences": vote(some & (words > 30 * F.col("n_ends")), some & (words < 25 * F.col("n_ends")) & (words >= 5 * F.col("n_ends"))),
        "lines": vote(some & (words > 150 * F.col("n_lines")), some & (words < 80 * F.col("n_lines")) & (words >= 8 * F.col("n_lines"))),
        "dup_lines": vote(share("n_dup_lines", "n_lines") > 0.3, (F.col("n_lines") >= 4) & (F.col("n_dup_lines") == 0)),
        "repeats": vote(share("n_repeat_words", "n_words") > 0.15, (words >= 40) & (share("n_repeat_words", "n_words") < 0.05)),
        "variety": vote((words >= 40) & (share("n_distinct", "n_words") < 0.4), (words >= 40) & (share("n_distinct", "n_words") > 0.6)),
        "capitals": vote(share("n_upper", "n_letters") > 0.3, (F.col("n_letters") >= 40) & (share("n_upper", "n_letters") < 0.06)),
        "bangs": vote(share("n_bangs", "n_words") > 0.1, some & (share("n_bangs", "n_words") < 0.02)),
    }


class Estimates:
    """The shares of good texts and of junk, and how often each rule's votes on either say good.

    Two classes with votes that are independent within each. An abstention says nothing about the class; only the
    votes that were cast count. The first guess counts junk votes: with n of them a text is junk by n / (n + 1).
    """

    #: Each class's says_good begins at these, with the weight of ``PRIOR`` votes.
    START = {"good": 0.9, "junk": 0.5}
    PRIOR = 2.0

    def __init__(self, rules: int):
        self.shares = {"good": 0.85, "junk": 0.15}
        self.says_good = {k: [x] * rules for k, x in self.START.items()}

    def weights(self, kind: str) -> list[list[float]]:
        """For each rule, the logarithm of the chance of its vote: abstain, junk, good."""
        return [[0.0, math.log(1 - x), math.log(x)] for x in self.says_good[kind]]

    def evidence(self) -> tuple[float, list[list[float]]]:
        """The log-odds of good before any vote, and what each rule's vote adds to them."""
        start = math.log(self.shares["good"]) - math.log(self.shares["junk"])
        return start, [[g - j for g, j in zip(a, b, strict=True)] for a, b in zip(self.weights("good"), self.weights("junk"), strict=True)]

    def posterior(self, votes: tuple[int, ...]) -> float:
        """The probability that a text with these votes is good."""
        start, added = self.evidence()
        return logistic(start + sum(w[v] for w, v in zip(added, votes, strict=True)))

    def fit(self, patterns: dict[tuple[int, ...], int], rounds: int = 500) -> Estimates:
        rows = sum(patterns.values())
        good = {p: 1 / (p.count(JUNK) + 1) if JUNK in p else 0.98 for p in patterns}
        for _ in range(rounds if rows else 0):
            for kind, start in self.START.items():
                held = {p: n * (good[p] if kind == "good" else 1 - good[p]) for p, n in patterns.items()}
                self.shares[kind] = (sum(held.values()) + 1) / (rows + 2)
                for j in range(len(self.says_good[kind])):
                    yes, no = (sum(h for p, h in held.items() if p[j] == v) for v in (GOOD, JUNK))
                    self.says_good[kind][j] = (yes + self.PRIOR * start) / (yes + no + self.PRIOR)
            start, added = self.evidence()
            now = {p: logistic(start + sum(w[v] for w, v in zip(added, p, strict=True))) for p in patterns}
            moved = max(abs(now[p] - good[p]) for p in patterns)
            good = now
            if moved < 1e-7:
                break
        return self


def logistic(x: float) -> float:
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


def learn(voted: DataFrame, votes: list[Column]) -> Column:
    """The posterior probability of good, learned from the vote columns of all rows of ``voted``."""
    patterns = {tuple(r[:-1]): r[-1] for r in voted.select(*(v.alias(f"v{i}") for i, v in enumerate(votes))).groupBy(*(f"v{i}" for i in range(len(votes)))).agg(F.count(F.lit(1))).collect()}
    start, added = Estimates(len(votes)).fit(patterns).evidence()
    logs = F.lit(start)
    for w, v in zip(added, votes, strict=True):
        logs = logs + F.get(F.array(*map(F.lit, w)), v)
    return 1 / (1 + F.exp(-logs))


def judge(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """Per row: id, text_hash, the measures, votes by rule, and good, the posterior probability."""
    found = durable(measures(df, text, {"id": F.col(id_col)})).withColumns({f"vote_{k}": v for k, v in rules().items()})
    return found.withColumn("good", learn(found, [F.col(f"vote_{k}") for k in rules()]))


def only_good(df: DataFrame, text: Column) -> DataFrame:
    """The rows of ``df`` that the rules keep. The rows carry their measures through the shared folder, so no join brings the two together again."""
    whole = "whole"
    found = measures(df, text, {whole: F.struct(*(F.col(quoted(c)) for c in df.columns))})
    found = durable(found.withColumns({f"vote_{k}": v for k, v in rules().items()}))
    keep = found.withColumn("good", learn(found, [F.col(f"vote_{k}") for k in rules()])).filter(kept())
    return keep.select(f"{whole}.*")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def kept(least: float = 0.5) -> Column:
    return ~base_failed() & (F.col("good") >= least)
