"""The corpus pipeline: each stage works on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. Columns that ``documents`` has beside its own pass through, whatever their names. No stage fails on nulls in
any column, empty or very long texts, ties, repeated rows or an empty table; what it does with them stands with it.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightwake.llm import near_dedup, packing, quality_rules, secret_scan, source_mix
from brightwake.llm.common import durable, fresh, remove, shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep. Null and empty texts go; of repeated rows all stay or all go."""
    return quality_rules.only_good(docs, F.col("text"))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: one with the smallest id, once if it is repeated.

    Rows are told apart by id and text, so documents without an id, or with an id that others have too, stand
    for themselves; empty ones are near nothing, and each stays, once.
    """
    own_hash, hash_, id_, n = fresh(docs, "own_hash", "hash", "id", "n")
    kept = near_dedup.verdicts(docs, "doc_id", F.col("text")).filter("kept")
    kept = durable(kept.groupBy(F.col("root").alias("root"), F.col("id").alias(id_), F.col("text_hash").alias(hash_)).agg(F.count(F.lit(1)).alias(n)))
    one = kept.filter("root is not null").groupBy("root").agg(F.min(F.struct(hash_, n, id_)).alias("one")).select("one.*")
    first = one.union(kept.filter("root is null").select(hash_, n, id_))
    here = docs.withColumn(own_hash, near_dedup.text_hash(F.col("text")))
    same = (F.col(own_hash) == F.col(hash_)) & F.col("doc_id").eqNullSafe(F.col(id_))
    once = here.join(first.filter(F.col(n) == 1), same, "left_semi")
    repeated = here.join(first.filter(F.col(n) > 1), same, "left_semi").dropDuplicates(["doc_id", own_hash])
    return once.union(repeated).drop(own_hash)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret in their texts replaced; n_chars follows the text. Null and empty texts stay as they are."""
    model = secret_scan.learn(docs, "doc_id", F.col("text"))
    clean = secret_scan.clean(docs, "text", model)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, ordered by their places in the mix. Null sources are one source; rows that share an id, or have none, stand together."""
    return source_mix.mixed(docs, "doc_id", "source")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's bucket, batch and slot; each bucket's batches are filled in the order of the mix. Null and empty texts have one token; repeated rows a slot each."""
    placed = source_mix.mix(docs, "doc_id", "source", carry={"n_tokens": packing.byte_tokens(F.col("text"))})
    return packing.pack(placed, "id", F.col("n_tokens"), order_col="position").withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("near_dedup", deduplicated), ("secrets", without_secrets), ("mixing", mixing), ("packing", packed)]

#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again as the next one's input, which goes once that one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
