"""Whole texts go to Python in small batches (the pipeline was stopped beyond an executor's memory in round 3)."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eventfold.llm import minhash_join
from eventfold.llm.common import BATCH


@pytest.fixture
def usual(spark):
    before = spark.conf.get(BATCH)
    yield before
    spark.conf.set(BATCH, before)


def test_stages_work_in_small_batches(spark, sf_dir, usual):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert corpus_pipeline.encode(spark, docs, sf_dir).count() == docs.count() and spark.conf.get(BATCH) == "4m"


def test_near_duplicates_work_in_small_batches(spark, usual, monkeypatch):
    seen, own = [], minhash_join._widened
    monkeypatch.setattr(minhash_join, "_widened", lambda *a: seen.append(spark.conf.get(BATCH)) or own(*a))
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.lit(f"w{k}") for k in range(30)), (F.col("id") % 2).cast("string")).alias("text"))
    found = minhash_join.near_duplicates(docs)
    assert seen == ["4m"] and spark.conf.get(BATCH) == usual
    assert {r["component_id"] for r in found.collect()} == {0}
