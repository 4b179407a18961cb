"""The registered queries of the training-data operators, with production parameters, and their SQL.

Each query is thin: it reads whole tables, calls its operator and names the columns that its contract asks for.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, language_id, media, near_dedup, packing, quality_rules, secret_scan, sharding, source_mix, token_alignment, toxicity, url_rules, vector_codes

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(by: int) -> Column:
    """crc32 of the id as text, by which rows are held out; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % by


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = language_id.learn(docs.filter(remainder(3) != 1), "doc_id", "lang", F.col("text"))
    found = language_id.predict(docs, "doc_id", F.col("text"), trees).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (remainder(3) == 1).alias("held_out"), F.col("lang").alias("lang_pred"), "score")


#: The contract's rules.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    labels = url_rules.labelled(pages, "page_id", "url", "html", URL_RULES)
    return url_rules.judge(pages, "page_id", "url", URL_RULES, labels).withColumnRenamed("id", "page_id")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = secret_scan.learn(docs, "doc_id", F.col("text"))
    found = secret_scan.scan(docs, "doc_id", F.col("text"), model)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secret_scan.listed(F.col("base")), 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans")
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, "doc_id", packing.byte_tokens(F.col("text"))).withColumnRenamed("id", "doc_id")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))
    return found.withColumnRenamed("id", "doc_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))
    return judged.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality_rules.base_failed().alias("base_failed"), quality_rules.kept().alias("kept"), F.col("good").alias("posterior")
    )


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents"), "doc_id", "source").withColumnRenamed("id", "doc_id")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_rows(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return media.store_text(docs, "doc_id", F.col("text")).withColumnRenamed("id", "doc_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    classifier = toxicity.learn(docs, labels.filter(remainder(5) != 0), "doc_id", "toxic", F.col("text"))
    found = toxicity.score(docs, "doc_id", F.col("text"), classifier).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), "doc_id", F.col("text")).withColumnRenamed("id", "doc_id")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label").withColumnRenamed("id", "vec_id")


#: Where the tokenizers' files are; a cluster names its own folder.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_alignment.Vocabularies.read(spark, f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")
    digest = lambda groups: F.when(groups == "", "").otherwise(F.sha2(groups, 256))
    found = token_alignment.alignment(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), files, digest)
    return found.withColumnsRenamed({"id": "doc_id", "groups": "groups_sha256"})


QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_url_rules": op2_url_rules,
    "op3_secret_scan": op3_secret_scan,
    "op4_packing": op4_packing,
    "op5_near_dedup": op5_near_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_source_mix": op7_source_mix,
    "op8_sharding": op8_sharding,
    "op9_media": op9_media,
    "op10_toxicity": op10_toxicity,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_vector_codes": op12_vector_codes,
    "op13_token_alignment": op13_token_alignment,
}

#: All pairs by their shared shingles, and reachability; quadratic in the size of a group of copies, so for small tables only.
NEAR_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_distinct([array_to_string(words[i : i + 4], ' ') FOR i IN range(1, len(words) - 3)]) END AS shingles FROM w
), n AS (
    SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles FROM s
), u AS (
    SELECT doc_id, unnest(shingles) AS shingle FROM s
), pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM u AS a JOIN u AS b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM pairs JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n_shingles + y.n_shingles - shared)
), edges AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
    SELECT doc_id, doc_id AS other FROM n UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.other
), smallest AS (
    SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN smallest USING (doc_id)
"""

EXACT_SQL = r"""
WITH t AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS plain FROM documents
), g AS (
    SELECT plain, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY plain
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(plain) AS text_sha256 FROM t JOIN g USING (plain)
"""


def _round(k: int) -> str:
    """The assignment to the books of round k, and the books after it."""
    return f"""
d{k} AS (
    SELECT p.vec_id, p.part, b.entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS apart FROM parts AS p JOIN books{k} AS b ON p.part = b.part
), near{k} AS (
    SELECT vec_id, part, min(entry) AS entry, min(apart) AS apart FROM (SELECT *, min(apart) OVER (PARTITION BY vec_id, part) AS least FROM d{k}) WHERE apart = least GROUP BY vec_id, part
), sums{k} AS (
    SELECT part, entry, place, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS place FROM near{k} JOIN parts USING (vec_id, part)) GROUP BY ALL
), moved{k} AS (
    SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS v FROM sums{k} GROUP BY ALL
), books{k + 1} AS (
    SELECT part, entry, coalesce(m.v, b.v) AS v FROM books{k} AS b LEFT JOIN moved{k} AS m USING (part, entry)
)"""


CODES_SQL = f"""
WITH kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), parts AS (
    SELECT vec_id, part, v[part * (len(v) // 16) + 1 : (part + 1) * (len(v) // 16)] AS v FROM kept, range(16) AS r(part)
), books0 AS (
    SELECT part, dense_rank() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)
),{_round(0)},{_round(1)},{_round(2)}, coded AS (
    SELECT vec_id, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(apart) AS BIGINT) AS error FROM near2 GROUP BY vec_id
), digest AS (
    SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS place FROM books2)
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), digest
"""

ORACLES: dict[str, str] = {"op5_near_dedup": NEAR_SQL, "op11_exact_dedup": EXACT_SQL, "op12_vector_codes": CODES_SQL}
