"""One very long text and an empty table, for the operators that no other test gives them to."""

import numpy as np
import pytest

from eventfold.llm import collocations, importance, license_scan, mixing, quality_rules
from eventfold.llm.queries import vocabulary
from eventfold.llm.sentencepiece_codec import encode_decode
from eventfold.llm.token_counts import END_OF_TEXT, count_tokens, write_flat
from eventfold.llm.token_store import read_store, write_store

LONG = "Word and another one here, é🙂 " * 40_000 + "all rights reserved"
ROWS = [(2, LONG), (1, "short text"), (3, "short text"), (3, "short text"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in ROWS], "doc_id long, text string, source string, n_tokens int")


def by_bytes(text):
    import tokenizers

    return tokenizers.Tokenizer.from_file(vocabulary("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids


def test_sentencepiece(docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    got = sorted((str(r["doc_id"]), list(r["ids"]), r["decoded"]) for r in encode_decode(docs, vocabulary("piece_bpe_32k.model")).collect())
    each = [(str(k), library.encode(t or "", add_eos=True)) for k, t in ROWS]
    assert got == sorted((k, ids, library.decode(ids)) for k, ids in each)


def test_token_files(spark, docs):
    folder = write_store(docs, vocabulary("byte_bpe_50k.json"), end_id=0)
    found = {(r["doc_id"], r["nth"]): r for r in read_store(docs, folder).collect()}
    width = len(found[1, 0]["ids"]) // found[1, 0]["n_tokens"]
    for k, t in ((2, LONG), (1, "short text"), (None, None)):
        r = found[k, 0]
        assert np.frombuffer(r["ids"], f"<u{width}").tolist() == [*by_bytes(t), 0] and r["n_tokens"] == len(by_bytes(t)) + 1
    flat, order = write_flat(docs, vocabulary("byte_bpe_50k.json"))
    counted = count_tokens(spark, flat).join(order, ["file", "doc_no"])
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in counted.collect()) == sorted((str(k), len(by_bytes(t)) + 1) for k, t in ROWS)


def test_empty_token_files(spark, docs):
    empty = docs.limit(0)
    folder = write_store(empty, vocabulary("byte_bpe_50k.json"), end_id=0)
    assert read_store(empty, folder).count() == 0
    flat, order = write_flat(empty, vocabulary("byte_bpe_50k.json"))
    assert order.count() == 0 and count_tokens(spark, flat).count() == 0


def test_other_operators(spark, docs):
    sizes = {r["doc_id"]: r["size"] for r in mixing.mix(docs).collect()}
    assert sizes[2] == 240_003 and sizes[None] == 0
    rows = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    assert rows[2]["n_words"] == 240_003 and rows[2]["n_repeat_words"] == 240_000 and rows[2]["base_failed"]
    found = collocations.mine(docs.withColumn("lang", docs.source)).collect()
    assert {(r["phrase"], r["a"]) for r in found} == {("word and another one here", 40_000), ("é🙂 word and another one", 39_999)}
    drawn = {r["doc_id"]: r for r in importance.resample(docs, docs).collect()}
    assert drawn[2]["n_words"] == drawn[2]["n_features"] == 40_000 * 6 + 3 and drawn[None]["weight"] == 0
    assert license_scan.scan(docs.limit(0)).count() == 0 and [r["n_words"] for r in license_scan.scan(docs.where("doc_id = 1")).collect()] == [2]
