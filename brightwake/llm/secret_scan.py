"""Secret scans: character Markov models.

Fixed patterns find assignments, access keys and long hexadecimal runs. Beside them, first-order Markov models
over characters judge every other long token by its log-likelihood ratio: one model of ordinary identifiers, and one of
random strings for each alphabet that random strings are commonly written in. A token is held against the random model of
the smallest of these alphabets that has all its characters. All are trained from all documents. Random: strings
drawn for each alphabet, and the values that the fixed patterns find in the documents. Ordinary: the documents'
other tokens, those same words joined the way identifiers are, and decimal numbers. The threshold
comes from ordinary tokens held out of the training, at a stated rate of false positives.

Places are code points, ends exclusive. A text's matches are marked in one pass, cut at the marks and
measured; the mark is a noncharacter, and one that stands in a text counts as another such. The work
grows with a text's length and its number of matches, not with their product. Defined results: null and empty texts have no spans. Texts are
read whole, however long; matches are leftmost and don't overlap within a kind. Spans that start together come by
kind, then end. Equal texts have equal spans, so rows that repeat do; an empty table has no rows, and learning
from one leaves the drawn samples. All is SQL functions; the models are one array of numbers.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh
from .quality_rules import let

# The contract's patterns. What stands before them looks only where a match can begin.
ASSIGN = r"""(?=[PSTApsta])((?i)password|passwd|secret|token|api_?key)(?-i)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
KINDS = ["assign", "access", "hex", "markov"]

#: Shortest token that the models judge: below it, words and random strings overlap too much.
LEAST = 16
TOKEN = f"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}+"
#: The alphabets of random strings, the smallest first; a token belongs to the first that has all its characters.
ALPHABETS = ["[0-9a-f]*", "[0-9A-F]*", "[0-9a-z]*", "[0-9A-Z]*", ".*"]
#: Characters of a token lie between these codes.
LOW, HIGH = ord("+"), ord("z")
WIDTH = HIGH - LOW + 1
PLACES = WIDTH * WIDTH
MARK, OTHER = "￿", "￾"
SPAN = "struct<start:bigint,kind:int,end:bigint,text:string>"
#: Code points in each piece that a text is cut into before it is read at given places.
PIECE = 4096
#: Elements of an array whose running sums are worked out together; each costs a copy of what the run has so far.
RUN = 256


def running(values: Column, join: str) -> Column:
    """The running sums (``join`` is +) or maxima (greatest) of an array, a run of ``RUN`` elements at a time, then over the runs."""

    def both(a: Column, b: Column) -> Column:
        return F.coalesce(a, F.lit(0).cast("long")) + b if join == "+" else F.greatest(a, b)

    def one_run(x: Column) -> Column:
        return F.aggregate(x, F.array().cast("array<bigint>"), lambda out, v: F.array_append(out, both(F.get(out, F.size(out) - 1), v)))

    def joined(runs: Column) -> Column:
        ends = one_run(F.transform(runs, lambda r: F.element_at(r, -1)))
        return let(ends, lambda e: F.flatten(F.transform(runs, lambda r, k: F.transform(r, lambda v: both(F.get(e, k - 1), v)))))

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int")), lambda k: one_run(F.slice(values, k * RUN + 1, RUN)))
    return F.when(F.size(values) == 0, values).otherwise(let(runs, joined))


def found(text: Column, pattern: str, kind: int) -> Column:
    """All matches of the pattern as spans."""
    none = F.array().cast(f"array<{SPAN}>")

    def spans(parts: Column) -> Column:
        def placed(ends: Column) -> Column:
            every = F.transform(parts, lambda p, i: F.struct((F.get(ends, i) - F.length(p)).alias("start"), F.lit(kind).alias("kind"), F.get(ends, i).alias("end"), p.alias("text")))
            return F.filter(every, lambda s, i: i % 2 == 1)  # what stands between marks comes second

        return let(running(F.transform(parts, lambda p: F.length(p).cast("long")), "+"), placed)

    return F.when(text.rlike(pattern), let(F.split(F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}"), MARK, -1), spans)).otherwise(none)


def unmarked(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit(MARK), F.lit(OTHER))


def base_spans(text: Column) -> Column:
    assigned = F.filter(found(text, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 2)) >= 6)
    return F.array_sort(F.concat(assigned, found(text, ACCESS, 1), found(text, HEX, 2)))


def pairs(token: Column) -> Column:
    """A token's neighbouring characters as places in a model's table."""
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c) - LOW)
    return let(codes, lambda x: F.transform(F.slice(x, 1, F.size(x) - 1), lambda a, i: a * WIDTH + F.get(x, i + 1)))


def alphabet(token: Column) -> Column:
    """The number of the token's alphabet."""
    which = F.lit(len(ALPHABETS) - 1)
    for k in reversed(range(len(ALPHABETS) - 1)):
        which = F.when(token.rlike(f"^{ALPHABETS[k]}$"), k).otherwise(which)
    return which


@dataclass(frozen=True)
class Model:
    """The log-likelihood ratio of each pair of characters, a table for each alphabet, and the least sum that counts as random."""

    ratios: list[list[float]]
    least: float

    def ratio(self, token: Column) -> Column:
        """The log-likelihood ratio of a token."""
        tables = [F.from_json(F.lit(json.dumps(t)), "array<double>") for t in self.ratios]
        table = tables[-1]
        for k in reversed(range(len(tables) - 1)):
            table = F.when(alphabet(token) == k, tables[k]).otherwise(table)
        return let(table, lambda t: F.aggregate(pairs(token), F.lit(0.0), lambda a, p: a + F.get(t, p)))


def random_strings(spark: SparkSession, n: int) -> DataFrame:
    """``n`` strings drawn at random for each alphabet; those of the last are base 64 in both its forms."""
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256)
    coded = F.base64(F.unhex(digest))
    other = F.translate(coded, "+/=", "-_")
    letters = F.regexp_replace(coded, "[+/=]", "")
    text = F.array(digest, F.upper(digest), F.regexp_replace(letters, "[A-Z]", ""), F.regexp_replace(letters, "[a-z]", ""), F.when(F.col("id") % 2 == 0, coded).otherwise(other))
    return spark.range(n).select(F.posexplode(text).alias("alphabet", "token"))


def ordinary(words: DataFrame) -> DataFrame:
    """(token, parts) of identifiers, from tokens of texts in the order they stand in (``tokens``, an array): the tokens, and each three of them in turn joined as names, paths and constants are.

    ``parts`` have the same neighbouring characters as the token: joined words and what stands where they meet. Few parts differ, so they are counted, not the joined tokens.
    """
    three = F.transform(F.sequence(F.lit(0), F.floor(F.size("tokens") / 3).cast("int")), lambda i: F.slice("tokens", 3 * i + 1, 3))
    rows = words.select(F.explode(three).alias("three"))
    rows = rows.filter((F.array_join("three", "").rlike("^[A-Za-z]+$")) & (F.size("three") == 3)).select("three", F.crc32(F.array_join("three", " ")).alias("turn"))
    cased = lambda f: F.transform("three", f)
    none = F.lit("")
    forms = [(cased(F.lower), "_", none), (cased(F.upper), "_", none), (cased(F.initcap), "", none), (F.col("three"), "-", none), (F.col("three"), "/", none), (F.col("three"), "_", F.concat(F.lit("_"), F.col("turn") % 100))]
    which = (F.col("turn") % len(forms)).cast("int")
    form = None
    for k, (names, between, end) in enumerate(forms):
        one = F.struct(names.alias("names"), F.lit(between).alias("between"), end.alias("end"))
        form = F.when(which == k, one) if form is None else form.when(which == k, one)
    rows = rows.select(F.explode(F.array(form)).alias("f")).select("f.*")
    name, last, first = (lambda k: F.get("names", F.lit(k))), (lambda c: F.substring(c, -1, 1)), (lambda c: F.substring(c, 1, 1))
    meet = [F.concat(last(name(k)), "between", first(name(k + 1))) for k in (0, 1)] + [F.concat(last(name(2)), "end")]
    joined = rows.select(F.concat(name(0), "between", name(1), "between", name(2), "end").alias("token"), F.concat("names", F.array(*meet)).alias("parts"))
    return words.select(F.explode("tokens").alias("token")).select("token", F.array("token").alias("parts")).union(joined)


def numbers(spark: SparkSession, n: int) -> DataFrame:
    """``n`` decimal numbers and, so that runs count as ordinary, the alphabet and the digits in a row."""
    digits = F.regexp_replace(F.conv(F.substring(F.sha2(F.concat(F.lit("number "), F.col("id").cast("string")), 256), 1, 15), 16, 10), "^0+", "")
    rows = spark.range(1).select(F.explode(F.array(*(F.repeat(F.lit(x), 4) for x in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")))))
    return spark.range(n).select(digits.alias("token")).union(rows)


def learn(df: DataFrame, id_col: str, text: Column, docs: int = 600, drawn: int = 2000, held_out: int = 4, false_positives: float = 0.0005, least_ratio: float = 24.0) -> Model:
    """The models, from all documents, and ``drawn`` random strings for each alphabet.

    What is drawn weighs as it does beside ``docs`` documents: where there are more, what was counted in them is divided by how many times as many.
    One of ``held_out`` ordinary tokens trains nothing: of those that are long enough to be judged, each counted once, at most ``false_positives`` have the
    ratio that counts as random. It is ``least_ratio`` at least, for where few tokens are held out.
    """
    rows = df.select(unmarked(text).alias("text")).filter(text.isNotNull())
    share = max(1.0, rows.count() / docs)
    found = rows.select("text", base_spans(F.col("text")).alias("spans")).filter(F.size("spans") > 0)
    secret = found.select(F.explode(F.transform("spans", lambda s: F.when(s["kind"] == 0, F.regexp_extract(s["text"], ASSIGN, 2)).otherwise(s["text"]))).alias("token"))
    secret = secret.select(F.regexp_replace("token", "[.]", "").alias("token")).filter(F.length("token") >= LEAST).select(alphabet(F.col("token")).alias("alphabet"), "token")
    blank = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    plain = ordinary(rows.select(F.explode(F.array(F.regexp_extract_all(blank, F.lit("[A-Za-z0-9+/_=-]{3,}"), 0))).alias("tokens"))).withColumn("held", F.crc32("token") % held_out == 0)
    made = lambda rows, random, drawn: rows.select(F.lit(random).alias("random"), F.lit(drawn).alias("drawn"), "alphabet", "token")
    usual = lambda rows: rows.select(F.lit(0).alias("alphabet"), "token")
    tokens = made(random_strings(df.sparkSession, drawn), 1, True).union(made(secret, 1, False)).union(made(usual(numbers(df.sparkSession, drawn)), 0, True)).union(made(usual(plain.filter(~F.col("held")).select(F.explode("parts").alias("token"))), 0, False))
    tokens = tokens.filter(F.length("token") >= 2).groupBy("random", "drawn", "alphabet", "token").agg(F.count(F.lit(1)).alias("n"))
    counts = tokens.select("random", "drawn", "alphabet", F.explode(pairs(F.col("token"))).alias("pair"), "n").groupBy("random", "drawn", "alphabet", "pair").agg(F.sum("n").alias("n")).collect()
    seen = {(k, a): {} for k in (0, 1) for a in range(len(ALPHABETS))}
    for r in sorted(counts, key=lambda r: not r["drawn"]):
        own = seen[r["random"], r["alphabet"]]
        own[r["pair"]] = own.get(r["pair"], 0) + (r["n"] if r["drawn"] else r["n"] / share)
    usually = chances(seen[0, 0])
    ratios = [[ratio(p, x, y) for p, (x, y) in enumerate(zip(chances(seen[1, a]), usually, strict=True))] for a in range(len(ALPHABETS))]
    judged = plain.filter(F.col("held") & (F.length("token") >= LEAST)).select("token").distinct().select(Model(ratios, 0.0).ratio(F.col("token")).alias("ratio"))
    return Model(ratios, threshold(judged, least_ratio, false_positives))


def threshold(judged: DataFrame, least: float, false_positives: float) -> float:
    """A ratio, ``least`` at least, that no more than the share ``false_positives`` of the judged tokens reach.

    From ``least`` on, tokens are counted in bins, 256 for each doubling; the threshold is the end of a bin, so that few tokens fewer than might reach it do.
    """
    place = F.when(F.col("ratio") >= least, F.floor(F.log2(F.col("ratio") / least) * 256))
    bins = {r["place"]: r["count"] for r in judged.groupBy(place.alias("place")).count().collect()}
    left = math.floor(false_positives * sum(bins.values()))
    for k in sorted((k for k in bins if k is not None), reverse=True):
        left -= bins[k]
        if left < 0:
            return least * 2 ** ((k + 1) / 256) * (1 + 1e-9)
    return least


def ratio(pair: int, random: float, usual: float) -> float:
    """A character that follows itself, as in rulers and fillers, never speaks for a random string."""
    found = round(math.log(random / usual), 5)
    return min(0.0, found) if pair // WIDTH == pair % WIDTH else found


def chances(counts: dict[int, int], weight: float = 8.0) -> list[float]:
    """The chance of each character after each other, from counts of pairs; where few were seen, of the character alone."""
    alone, after = [1.0] * WIDTH, [0] * WIDTH
    for pair, n in counts.items():
        alone[pair % WIDTH] += n
        after[pair // WIDTH] += n
    total = sum(alone)
    return [(counts.get(p, 0) + weight * alone[p % WIDTH] / total) / (after[p // WIDTH] + weight) for p in range(PLACES)]


def added(text: Column, base: Column, model: Model) -> Column:
    """The tokens that count as random, where no fixed pattern has matched."""
    free = F.when(F.size(base) > 0, put_in(text, base, lambda a, b: F.repeat(F.lit(" "), (b - a).cast("int")))).otherwise(text)
    return F.filter(found(free, TOKEN, 3), lambda s: model.ratio(s["text"]) >= model.least)


def with_spans(df: DataFrame, text: Column, model: Model, base: str, spans: str) -> DataFrame:
    """``df`` with the spans of the fixed patterns as ``base`` and all spans as ``spans``, each sorted by start and kind."""
    (plain,) = fresh(df, "plain")
    rows = df.withColumn(plain, unmarked(text))
    rows = rows.withColumn(base, base_spans(F.col(plain)))
    return rows.withColumn(spans, F.array_sort(F.concat(base, added(F.col(plain), F.col(base), model)))).drop(plain)


def scan(df: DataFrame, id_col: str, text: Column, model: Model) -> DataFrame:
    """Per row: id, base (what the fixed patterns found) and spans (all)."""
    rows = df.select(F.col(id_col).alias("id"), text.alias("text"))
    return with_spans(rows, F.col("text"), model, "base", "spans").select("id", "base", "spans")


def clean(df: DataFrame, text_col: str, model: Model, put: str = "[SECRET]") -> DataFrame:
    """``df`` with each run of overlapping secrets in the text replaced; a null text stays null."""
    base, spans = fresh(df, "base", "spans")
    marked = with_spans(df, F.col(text_col), model, base, spans)
    text = F.when(F.size(spans) > 0, put_in(F.col(text_col), F.col(spans), lambda a, b: F.lit(put))).otherwise(F.col(text_col))
    return marked.withColumn(text_col, text).drop(base, spans)


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def put_in(text: Column, spans: Column, put) -> Column:
    """The text with ``put(start, end)`` in the place of each run of overlapping spans, which are sorted and not empty.

    The text is cut into pieces first, so that what stands between two spans is read where it is.
    """

    def between(pieces: Column, a: Column, b: Column) -> Column:
        first, last = F.expr("0L") + F.floor(a / PIECE), F.floor((F.greatest(a, b) - 1) / PIECE)
        some = F.array_join(F.slice(pieces, (first + 1).cast("int"), F.greatest(last - first + 1, F.lit(0)).cast("int")), "")
        return F.substring(some, (a - first * PIECE + 1).cast("int"), (b - a).cast("int"))

    def replaced(pieces: Column) -> Column:
        def runs(ends: Column) -> Column:
            before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0).cast("long"))
            # A run ends where the next span starts at or after all ends so far.
            over = lambda i: F.coalesce(F.get(spans, i + 1)["start"] >= F.get(ends, i), F.lit(True))
            starts = running(F.transform(spans, lambda s, i: F.when(s["start"] >= before(i), s["start"]).otherwise(F.lit(0).cast("long"))), "greatest")
            first = let(starts, lambda x: F.filter(F.transform(x, lambda a, i: F.when(over(i), F.struct(a.alias("a"), F.get(ends, i).alias("b")))), lambda r: r.isNotNull()))
            return let(first, parts)

        def parts(r: Column) -> Column:
            each = F.transform(r, lambda x, i: F.concat(between(pieces, F.coalesce(F.get(r, i - 1)["b"], F.lit(0).cast("long")), x["a"]), put(x["a"], x["b"])))
            end = F.element_at(r, -1)["b"]
            return F.concat(F.array_join(each, ""), between(pieces, end, F.length(text).cast("long")))

        return let(running(F.transform(spans, lambda s: s["end"]), "greatest"), runs)

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), 0), replaced)
