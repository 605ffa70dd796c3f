"""A training-data pipeline over the table of documents, in stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again
as the next one's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.llm import langid, minhash_join, mixing, sentencepiece_codec, toxicity
from eventfold.llm.common import BATCH, Steps, addressed, by_class, filtered, table
from eventfold.llm.queries import vocabulary


def _in_small_batches(stage):
    """The stage with batches of 4 MB between Spark and Python. Its result is worked out after it
    returns, so the session keeps the setting."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH, "4m")
        return stage(spark, docs, sf_dir)

    return run_stage


@_in_small_batches
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in none of the languages that are learned from the documents' own non-null
    `lang`: null texts, texts without a letter, and texts whose predicted bits are further from
    every language's codeword than those of any row trained on, by a margin. Without a row to
    learn from only what has no letter goes."""
    return filtered(docs, "text", langid.train(docs, F.lit(True)).known)


@_in_small_batches
def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic, learned from the labels of the documents left: equal
    texts all stay or all go, whatever their ids. Null and empty texts score as an empty window and
    stay; without labels of both kinds all are judged alike. An empty table stays empty."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return filtered(docs, "text", lambda texts: model.scores(texts) < 0.5)


@_in_small_batches
def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates (shingles of five words, similarity 0.8) the row
    with the least id, rows without an id last. Rows are told apart by their place in the table:
    of rows that share an id those with other texts stay, of equal rows one stays."""
    rows, row = addressed(docs)
    steps = Steps(spark)
    found = steps.saved(minhash_join.near_duplicates(rows, key=row), "groups")
    several = found.where("component_id is not null").groupBy("component_id").agg(F.count("*").alias("copies")).where("copies > 1")
    members = by_class(found.select(row, "component_id"), several, ["component_id"], found.count()).select(row, "component_id")
    named = members.join(rows.select(row, F.col("doc_id").alias("__id")), row)
    first = F.min_by(row, F.struct(F.col("__id").isNull(), "__id", row))
    stay = named.groupBy("component_id").agg(first.alias(row)).select(row)
    gone = steps.saved(members.select(row).join(stay, row, "left_anti"), "gone")
    steps.drop(found)
    # Texts move once, by the row, at every size of the table.
    return rows.join(gone.hint("merge"), row, "left_anti").select(docs.columns)


@_in_small_batches
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources meet their target weights, in whole copies:
    a part of half a document or more counts as one. Each row is drawn for itself, also where
    ids repeat or are missing; documents without words go."""
    rows, row = addressed(docs)
    found = mixing.mix(rows, key=row, by=("doc_id", "source"))
    half = ((F.col("part") * 2 >= F.col("size")) & (F.col("size") > 0)).cast("long")
    copies = found.select(row, (F.col("copies") + half).cast("int").alias("__copies")).where("__copies > 0")
    # Texts move once, by the row, at every size of the table.
    each = rows.join(copies.hint("merge"), row).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return each.select(docs.columns)


@_in_small_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids, decoded), one for each of the mixed documents, copies and rows of
    equal or null id among them; null and empty texts give the end id alone, an empty table no rows."""
    found = sentencepiece_codec.encode_decode(docs, vocabulary("piece_bpe_32k.model"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("language", language), ("clean", clean), ("deduplicate", deduplicate), ("mix", mix), ("encode", encode)]

#: Trained classifiers, hashing and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, steps = table(spark, sf_dir, "documents"), Steps(spark)
    for name, stage in STAGES[:-1]:
        before, docs = docs, steps.saved(stage(spark, docs, sf_dir), name)
        steps.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
