"""The registered queries: columns, types, folds, and the same rows from DuckDB."""

import zlib

import duckdb
import pandas as pd
import pytest

from eventfold.llm.queries import SQL, queries

TYPES = {
    "op1_sentencepiece": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op2_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op3_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_embeddings": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op5_token_store": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op6_token_counts": "doc_id bigint, n_tokens bigint",
    "op7_syncmers": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op8_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op9_licenses": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op10_minhash": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op11_collocations": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
    "op12_importance": "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint",
    "op13_quality": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
}


def same_columns(df, name):
    return df.dtypes[: TYPES[name].count(",") + 1] == [tuple(c.strip().split(" ")) for c in TYPES[name].split(",")]


@pytest.mark.parametrize("name", [n for n in TYPES if n not in SQL])
def test_columns(spark, sf_dir, name):
    assert same_columns(queries()[name](spark, sf_dir), name)


@pytest.mark.parametrize("name", list(SQL))
def test_same_rows(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = queries()[name](spark, sf_dir)
    assert name not in TYPES or same_columns(df, name)
    got, want = df.toPandas(), c.sql(SQL[name]).df()
    rows = lambda df: sorted(tuple("null" if pd.isna(v) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
    assert sorted(got.columns) == sorted(want.columns)
    for x in ("first_word", "last_word", "rank"):
        if x in got:
            got[x], want[x] = got[x].astype("Int64"), want[x].astype("Int64")
    assert rows(got) == rows(want)


@pytest.mark.parametrize(("name", "folds", "held"), [("op3_toxicity", 5, 0), ("op8_language", 4, 2)])
def test_held_out_rows(spark, sf_dir, name, folds, held):
    rows = queries()[name](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held) and 0 <= r["score"] <= 1 for r in rows)


def test_toxicity_of_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = queries()["op3_toxicity"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in rows) >= 0.9 * len(rows)  # a sixth of the toxic labels stand at texts without an insult
