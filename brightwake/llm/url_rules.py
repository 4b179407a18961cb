"""URL filters: association rules.

A URL's tokens (words of its host, parts of its path) and its label, where it has one, form a basket.
Spark's FP-growth mines the frequent combinations, or, where URLs are wide, level by level what can still be a rule; those that
imply a label with enough confidence and support are rules. A URL without a label counts against both labels, so a combination that is common
outside the labelled part doesn't pass. Rules that a shorter one implies go, in Spark; all others stay, in a
table keyed by each rule's rarest token: an inverted index, so that a URL is held only against rules that it may fit.

FP-growth makes every subset of what is frequent. So tokens that the very same URLs have are twins: they are one item, and a URL
has it if it has any of them, which is what a rule for each twin would say. And where a URL still has more than ``WIDE`` items,
rules are mined by ``by_levels`` instead, over all items of all URLs: the result is the same, and no item or combination is left out. Tokens that
more than ``COMMON`` of the URLs have tell nothing, and are left out.

Labels are given as a table; ``labelled`` makes one from a bounded sample of pages, by listed rules and by what
the pages say. Listed rules (host, path prefix, verdict) come first; the longest that fits wins.

Defined results: a null URL and one without ``://`` have empty host and path, no tokens, and the verdict allow. Very
long URLs are read whole. Of mined rules that fit, the one of the highest confidence decides, then support, then the
names; rows that repeat get the same verdict each. An empty table gives no rows, and without labels nothing is mined.
"""

from __future__ import annotations

import functools
import itertools
import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quality_rules
from .common import durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
RULES = "items array<string>, label string, confidence double, support double, key string"
#: Tokens that more than this share of the URLs have tell nothing.
COMMON = 0.9
#: Most items of one URL for FP-growth, which makes all subsets; wider ones are mined level by level.
WIDE = 10


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def listed_rule(host_col: Column, path_col: Column, rules: dict[str, str]) -> Column:
    """The longest of the rules, given as ``host/path``, that fits; null if none does."""
    fits = None
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        name, slash, rest = rule.partition("/")
        one = ((host_col == name) | host_col.endswith("." + name)) & path_col.startswith(slash + rest)
        fits = F.when(one, rule) if fits is None else fits.when(one, rule)
    return F.lit(None).cast("string") if fits is None else fits


def tokens(host_col: Column, path_col: Column) -> Column:
    """Host words as ``h:word``, path parts as ``p:part``, with each number as ``#``."""
    words = F.transform(F.split(host_col, "[.-]"), lambda w: F.concat(F.lit("h:"), w))
    parts = F.transform(F.split(path_col, "/"), lambda w: F.concat(F.lit("p:"), F.regexp_replace(F.lower(w), "[0-9]+", "#")))
    return F.array_distinct(F.filter(F.concat(words, parts), lambda t: F.length(t) > 2))


def page_text(html: Column) -> Column:
    """What a page's body says, a line for each block, without markup, scripts and styles; empty for null."""
    for pattern, put in ((r"(?is)<(script|style|head|nav)\b.*?</\1\s*>|<!--.*?-->", " "), (r"(?i)</?(p|br|h[1-6]|li|ul|div|article|footer|table|tr|section)\b[^>]*>", "\n"), (r"(?s)<[^>]*>", " "), (r"&[a-zA-Z#0-9]{2,10};", " ")):
        html = F.regexp_replace(html, pattern, put)
    return F.coalesce(html, F.lit(""))


def labelled(pages: DataFrame, id_col: str, url_col: str, html_col: str, rules: dict[str, str], pages_read: int = 20_000, sure: float = 0.9) -> DataFrame:
    """(url, label) of about ``pages_read`` pages, chosen by a hash of their ids.

    A listed rule that fits gives its verdict. Any other page is labelled by what it says: allow where the quality
    rules' posterior of a good text is ``sure`` at least, block where that of junk is, else nothing.
    """
    total = pages.count()
    place = F.pmod(F.xxhash64(id_col, F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    chosen = pages.filter((place < pages_read / max(1, total)) & F.col(url_col).isNotNull())
    found = quality_rules.measures(chosen, page_text(F.col(html_col)), {"url": F.col(url_col)})
    votes = list(quality_rules.rules().values())
    found = durable(found.select("url", *(v.alias(f"v{i}") for i, v in enumerate(votes))))
    good = quality_rules.learn(found, [F.col(f"v{i}") for i in range(len(votes))])
    said = F.when(good >= sure, "allow").when(good <= 1 - sure, "block")
    return found.select("url", F.coalesce(listed_verdict(F.col("url"), rules), said).alias("label"))


def listed_verdict(url: Column, rules: dict[str, str]) -> Column:
    """The verdict of the listed rule that fits a URL; null if none does."""
    verdicts = F.create_map(*(F.lit(x) for r in rules.items() for x in r)) if rules else F.lit(None).cast("map<string,string>")
    return F.try_element_at(verdicts, listed_rule(host(url), path(url), rules))


def items_of(rows: DataFrame, names: DataFrame) -> DataFrame:
    """(row, items): the items that each row's tokens stand for; rows without any are left out."""
    each = rows.select("row", F.explode("tokens").alias("t")).join(names.select("t", "item"), "t")
    return each.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))


def named(baskets: DataFrame, least: int, total: int) -> DataFrame:
    """(t, item, n, pure) of the tokens that may be in a rule: what twins share, how many URLs have it, and the larger share of a label."""
    each = baskets.select("row", "label", F.explode("tokens").alias("t"))
    mark = lambda seed: F.bit_xor(F.xxhash64("row", F.lit(seed)))
    said = lambda label: F.count_if(F.coalesce(F.col("label") == label, F.lit(False)))
    counts = each.groupBy("t").agg(F.count(F.lit(1)).alias("n"), mark(1).alias("x"), mark(2).alias("y"), F.greatest(said("allow"), said("block")).alias("most"))
    counts = durable(counts.filter((F.col("n") >= least) & (F.col("n") <= COMMON * total)))
    twins = counts.groupBy("n", "x", "y").agg(F.min("t").alias("item"))
    return durable(counts.join(twins, ["n", "x", "y"]).select("t", "item", "n", (F.col("most") / F.col("n")).alias("pure")))


def rule_table(baskets: DataFrame, min_support: float = 0.001, min_confidence: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """Rules from a table of ``tokens`` and ``label`` (block, allow or null), with their rarest items as ``key``; and the items by token (``named``)."""
    spark = baskets.sparkSession
    baskets = durable(baskets.select(F.array_distinct(F.coalesce("tokens", F.array().cast("array<string>"))).alias("tokens"), "label").withColumn("row", F.monotonically_increasing_id()))
    total = baskets.count()
    least = max(1, math.ceil(min_support * total - 1e-9))
    names = named(baskets, least, total)
    if not total:
        return spark.createDataFrame([], RULES), names
    rows = durable(baskets.select("row", "label").join(items_of(baskets, names), "row", "left").select("row", "label", F.coalesce("items", F.array().cast("array<string>")).alias("items")))
    singles = names.select("item", "n").distinct()
    if not rows.filter(F.size("items") > WIDE).isEmpty():
        found = by_levels(rows, least, total, min_confidence)
    else:
        label = F.when(F.col("label").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("label="), F.col("label"))))
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / total, minConfidence=min_confidence, numPartitions=parts).fit(rows.select(F.concat("items", label).alias("items")))
        right = F.get("consequent", F.lit(0))
        found = model.associationRules.filter(right.startswith("label=")).select(F.array_sort("antecedent").alias("items"), F.substring(right, 7, 99).alias("label"), "confidence", "support")
    rules = unimplied(durable(found))
    out = keyed(rules, singles).select("items", "label", F.round("confidence", 9).alias("confidence"), F.round("support", 9).alias("support"), "key")
    return out, names


def keyed(rules: DataFrame, singles: DataFrame) -> DataFrame:
    """``rules`` with the rarest of their items as ``key``."""
    rare = rules.select("items", "label", F.explode("items").alias("item")).join(singles, "item").groupBy("items", "label").agg(F.min(F.struct("n", "item"))["item"].alias("key"))
    return rules.join(rare, ["items", "label"])


def by_levels(rows: DataFrame, least: int, total: int, min_confidence: float) -> DataFrame:
    """(items, label, confidence, support) of every rule over (row, label, items), but for some that a shorter one implies.

    Sets of k + 1 items are put together, in the rows that have them, from sets of k that are open for a label. A set is open if ``least`` rows with the
    label have it, and if each of its items keeps out rows without the label. If one keeps out none, the set without it has as few such
    rows and as many with the label, so it is no less sure; the same holds whatever is added to both. So no longer set is missed that a shorter one doesn't imply.
    """
    has = rows.select("row", F.col("label").alias("own_label"), F.explode(F.transform("items", lambda t: F.array(t))).alias("items"))
    of = lambda label: F.struct(F.lit(label).alias("label"), F.count_if(F.coalesce(F.col("own_label") == label, F.lit(False))).alias("own"))
    found, before, size = [], None, 1
    while True:
        has = durable(has)
        counts = has.groupBy("items").agg(F.count(F.lit(1)).alias("n"), F.array(of("allow"), of("block")).alias("by_label"))
        sets = counts.select("items", "n", F.inline("by_label")).filter(F.col("own") >= least).withColumn("wrong", F.col("n") - F.col("own"))
        if before is not None:
            part = sets.select("items", "label", "wrong", F.explode(F.transform("items", lambda t: F.array_remove("items", t))).alias("part"))
            part = part.join(before.select(F.col("items").alias("part"), "label", F.col("wrong").alias("part_wrong")), ["part", "label"]).filter("part_wrong > wrong")
            sets = sets.join(part.groupBy("items", "label").count().filter(F.col("count") == size).drop("count"), ["items", "label"], "left_semi")
        sets = durable(sets)
        found.append(sets.select("items", "label", (F.col("own") / F.col("n")).alias("confidence"), (F.col("own") / total).alias("support")).filter(F.col("confidence") >= min_confidence))
        before = sets.filter("wrong > 0")
        if before.isEmpty():
            return functools.reduce(DataFrame.unionByName, found)
        open_ = has.join(before.select("items").distinct(), "items", "left_semi").select("row", "own_label", F.slice("items", 1, size - 1).alias("head"), F.element_at("items", -1).alias("last"))
        more = open_.select("row", "head", F.col("last").alias("next"))
        has = open_.join(more, ["row", "head"]).filter("last < next").select("row", "own_label", F.concat("head", F.array("last", "next")).alias("items"))
        size += 1


def unimplied(rules: DataFrame) -> DataFrame:
    """The rules without those that a shorter one of the same label and at least their confidence implies.

    Whatever an implied rule implies is implied by a shorter one too, so each rule is held against all others at once, by the others' first items.
    """
    part = rules.select(F.get("items", F.lit(0)).alias("t"), F.col("items").alias("part"), F.col("label").alias("part_label"), F.col("confidence").alias("part_confidence"))
    implied = (
        rules.filter(F.size("items") > 1).withColumn("t", F.explode("items")).join(part, "t")
        .filter((F.size("part") < F.size("items")) & (F.col("label") == F.col("part_label")) & (F.col("part_confidence") >= F.col("confidence")) & (F.size(F.array_except("part", "items")) == 0))
        .select("items", "label").distinct()
    )
    return durable(rules.join(implied, ["items", "label"], "left_anti"))


def mine(baskets: DataFrame, min_support: float = 0.001, min_confidence: float = 0.95) -> list[dict]:
    """``rule_table`` as a list, best first, with a rule for each choice among twins."""
    rules, names = rule_table(baskets, min_support, min_confidence)
    twins: dict[str, list[str]] = {}
    for r in names.orderBy("t").collect():
        twins.setdefault(r["item"], []).append(r["t"])
    found = []
    for r in rules.collect():
        found += [r.asDict() | {"items": sorted(choice)} for choice in itertools.product(*(twins[x] for x in r["items"]))]
    return sorted(found, key=lambda r: (len(r["items"]), -r["confidence"], -r["support"], r["items"], r["label"]))


def match(rows: DataFrame, rules: DataFrame, names: DataFrame) -> DataFrame:
    """``rows``, told apart by ``row``, with the best rule that fits ``tokens`` as the struct ``mined``: by confidence, then support, then the names; null if none."""
    own = items_of(rows, names).select("row", F.col("items").alias("own_items"))
    near = own.withColumn("key", F.explode("own_items")).join(rules, "key").filter(F.size(F.array_except("items", "own_items")) == 0)
    best = near.groupBy("row").agg(F.max(F.struct("confidence", "support", "label", "items")).alias("mined"))
    return rows.join(best, "row", "left")


def judge(df: DataFrame, id_col: str, url_col: str, rules: dict[str, str], labels: DataFrame, min_support: float = 0.001, min_confidence: float = 0.9) -> DataFrame:
    """Per row: id, host, path, rule, verdict and the mined items that decided it.

    ``rules`` are listed rules as ``host/path`` with their verdicts. ``labels`` has the URLs to learn from, as
    ``url`` and ``label`` (block, allow or null); what is mined from them decides all URLs that no listed rule fits.
    """
    url = F.col(url_col)
    rows = df.select(F.col(id_col).alias("id"), host(url).alias("host"), path(url).alias("path"), listed_verdict(url, rules).alias("listed"))
    rows = rows.withColumn("rule", listed_rule(F.col("host"), F.col("path"), rules)).withColumn("tokens", tokens(F.col("host"), F.col("path")))
    rows = durable(rows.withColumn("row", F.monotonically_increasing_id()))
    baskets = durable(labels.select(tokens(host(F.col("url")), path(F.col("url"))).alias("tokens"), "label"))
    rules_mined, names = rule_table(baskets, min_support, min_confidence)
    return match(rows, durable(rules_mined), names).select(
        "id", "host", "path", "rule", F.coalesce("listed", F.col("mined.label"), F.lit("allow")).alias("verdict"), F.array_join("mined.items", " ").alias("mined_items"), F.col("mined.confidence").alias("mined_confidence")
    )
