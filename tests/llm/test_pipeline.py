"""The pipeline's stages on whole small tables and on awkward rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from brightwake.llm import packing, source_mix

from .helpers import CLASHING, DOCS, awkward, near_groups

DIR = "/root/testdata/sf0.001"


def test_stages_in_turn(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        stage(spark, docs, DIR).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = {r["doc_id"]: r for r in docs.collect()}
        assert len(after) == docs.count() and set(after) <= set(before), name
        assert name == "packing" or docs.columns == columns
        seen[name] = (before, after)
    before, after = seen["near_dedup"]
    assert set(after) == {i for i, c in near_groups([(i, r["text"]) for i, r in before.items()]).items() if i == c}
    before, after = seen["secrets"]
    assert set(before) == set(after) and all(r["n_chars"] == len(r["text"]) for r in after.values())
    assert all(after[i]["text"] == r["text"] for i, r in before.items() if "token" not in r["text"].lower() and "[SECRET]" not in after[i]["text"])
    for name in ("mixing", "packing"):
        assert set(seen[name][0]) == set(seen[name][1])
    assert set(seen["mixing"][0].values()) == set(seen["mixing"][1].values())


def test_run_is_all_stages(spark):
    assert pipeline.run(spark, DIR).columns == ["doc_id", "n_tokens", "bucket", "bucket_len", "batch", "slot", "padding"]


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stage_on_awkward_rows(spark, name):
    stage = dict(pipeline.STAGES)[name]
    for rows in (awkward(spark), awkward(spark).select("doc_id", "text", "lang", "source", "n_chars"), spark.createDataFrame([], DOCS), spark.createDataFrame([], CLASHING)):
        out = stage(spark, rows, DIR)
        if name != "packing":
            assert out.columns == rows.columns
        n, m = out.count(), rows.count()
        assert n == m if name in ("secrets", "mixing", "packing") else n <= m


def test_repeated_rows_leave_one(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = spark.createDataFrame([(1, text), (1, text), (2, text + " end"), (3, "other text of some words")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in dict(pipeline.STAGES)["near_dedup"](spark, rows, DIR).collect()) == [1, 3]


def test_mix_is_the_order_of_the_files(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    mixed = dict(pipeline.STAGES)["mixing"](spark, docs, DIR)
    first = [r["source"] for r in mixed.withColumn("i", F.monotonically_increasing_id()).orderBy("i").limit(64).collect()]
    assert len(set(first)) >= 4


def test_documents_without_an_id_stand_for_themselves(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(None, a), (None, a), (None, a + " end"), (None, b), (None, c + " end"), (1, c), (2, d), (2, "other text of some words here"), (3, d + " end"), (None, ""), (None, None), (None, " "), (4, "")]
    found = dict(pipeline.STAGES)["near_dedup"](spark, spark.createDataFrame(rows, "doc_id long, text string"), DIR).collect()
    texts = sorted((r["doc_id"] or 0, r["text"] or "") for r in found)
    assert (0, a) in texts or (0, a + " end") in texts
    assert [t for t in texts if t not in ((0, a), (0, a + " end"))] == sorted([(0, ""), (0, " "), (0, b), (1, c), (2, d), (2, "other text of some words here"), (4, "")])
    assert len(texts) == 8


def test_batches_are_mixed(spark):
    """A hot source with the lowest ids: each batch has the others' share of the mix all the same."""
    text = "x" * 4095
    docs = spark.createDataFrame([(i, text, "en", "hot" if i < 900 else "cold", 4095) for i in range(1000)], DOCS)
    found = [(r["batch"], r["slot"], r["doc_id"]) for r in dict(pipeline.STAGES)["packing"](spark, docs, DIR).collect()]
    assert len(set(found)) == 1000
    first = [i for batch, _, i in found if batch < 16]
    assert len(first) == 256 and abs(sum(i >= 900 for i in first) - 64) <= 16


def test_batches_follow_the_weights(spark):
    docs = spark.createDataFrame([(i, "ab"[i // 500]) for i in range(1000)], "doc_id long, source string")
    for weight in (1, 3):
        placed = source_mix.mix(docs, "doc_id", "source", {"a": 1, "b": weight}, carry={"n": F.lit(64)})
        found = packing.pack(placed, "id", F.col("n"), token_budget=8192, order_col="position").filter("batch = 0").collect()
        assert len(found) == 128 and sum(r["id"] >= 500 for r in found) == 128 * weight // (1 + weight)
