"""The queries that SQL can't express, against the libraries and plain loops over single texts."""

import hashlib
import zlib

import numpy as np
import pytest

from eventfold.llm import langid, toxicity
from eventfold.llm.common import fold
from eventfold.llm.queries import queries, vocabulary


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def sha(data):
    return hashlib.sha256(data.encode()).hexdigest()


def test_sentencepiece_query(spark, sf_dir, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    rows = queries()["op1_sentencepiece"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))


def test_token_store_query(spark, sf_dir, texts):
    import tokenizers

    library = tokenizers.Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    rows = {r["doc_id"]: r for r in queries()["op5_token_store"](spark, sf_dir).collect()}
    done = 0
    for key in sorted(texts):
        ids = [*library.encode(texts[key], add_special_tokens=False).ids, 0]
        assert (rows[key]["start"], rows[key]["n_tokens"], rows[key]["ids_crc32"]) == (done, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        done += len(ids)
    assert len(rows) == len(texts)


def words(text, digits):
    """The text as ' word word ', every other character between words one space."""
    low = lambda c: c.lower() if len(c.lower()) == 1 else c
    found = "".join(low(c) if c.isalpha() or (digits and c.isdigit()) else " " for c in text).split()
    return f" {' '.join(found)} " if found else " "


def bucket(gram, buckets):
    h = 2166136261 + len(gram)
    for c in gram:
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
        h ^= h >> 15
    return h & (buckets - 1)


def test_language_query(spark, sf_dir, texts):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(docs, fold("doc_id", 4) != 2)
    rows = {r["doc_id"]: r for r in queries()["op8_language"](spark, sf_dir).collect()}
    for key in sorted(texts)[::9]:
        s = words(texts[key], False)
        if len(s) < 2:
            assert (rows[key]["lang_pred"], rows[key]["score"]) == ("und", 0)
            continue
        found = np.zeros(langid.BUCKETS)
        for n in langid.ORDERS:
            for i in range(len(s) - n + 1):
                found[bucket(s[i : i + n], langid.BUCKETS)] += 1
        x = np.sqrt(found / found.sum())
        loss = []
        for code in model.code:
            total = 0.0
            for bit in range(model.code.shape[1]):
                margin = sum(x[k] * model.weights[k, bit] for k in np.flatnonzero(x)) + model.weights[-1, bit]
                total += model.trust[bit] * np.log1p(np.exp(-margin * code[bit]))
            loss.append(total)
        p = np.exp(min(loss) - np.array(loss))
        p /= p.sum()
        assert rows[key]["lang_pred"] == model.languages[int(p.argmax())] and rows[key]["score"] == pytest.approx(p.max(), abs=1e-3)


def toxic_score(model, text):
    """The worst window of eight words, half of which the next one shares."""
    values = []
    for w in words(text, True).split():
        spelled = f" {w} "
        grams = [spelled[i : i + n] for n in toxicity.ORDERS for i in range(len(spelled) - n + 1)]
        values.append(sum(model.pull[bucket(g, toxicity.BUCKETS)] for g in grams) / max(1, len(grams)))
    logit, begin, size, step = [], 0, toxicity.WINDOW, toxicity.WINDOW // 2
    while True:
        part = values[begin : begin + size]
        logit.append(sum(part) / len(part) + model.bias if part else model.empty)
        if begin + size >= len(values):
            return 1 / (1 + np.exp(-max(logit)))
        begin += step


def test_toxicity_query(spark, sf_dir, texts):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels, fold("doc_id", 5) != 0)
    rows = {r["doc_id"]: r for r in queries()["op3_toxicity"](spark, sf_dir).collect()}
    for key in sorted(texts)[::3]:
        want = toxic_score(model, texts[key])
        assert rows[key]["score"] == pytest.approx(want, abs=1e-6) and rows[key]["predicted"] == (want >= 0.5)


def test_clean_and_encode_stages(spark, sf_dir):
    """`clean` drops what scores as toxic by plain loops and nothing else, repeated, null and empty
    texts among them; `encode` gives every row's own ids."""
    import corpus_pipeline
    import sentencepiece

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (3, "", "en", "x", 0), (3, "", "en", "x", 0), (10**9, "🙂 <toxic> " * 9, None, None, 1)], docs.schema)
    given = docs.union(odd)
    model = toxicity.train(given, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold("doc_id", 0 + 1) >= 0)
    kept = corpus_pipeline.clean(spark, given, sf_dir)
    assert kept.columns == docs.columns
    show = lambda rows: sorted(str(r) for r in rows)
    assert show(kept.collect()) == show(r for r in given.collect() if toxic_score(model, r["text"] or "") < 0.5)
    assert corpus_pipeline.clean(spark, given.limit(0), sf_dir).count() == 0
    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    some = given.where("doc_id is null or doc_id < 40 or doc_id = 1000000000")
    want = sorted((str(r["doc_id"]), library.encode(r["text"] or "", add_eos=True)) for r in some.collect())
    rows = corpus_pipeline.encode(spark, some, sf_dir).collect()
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in rows) == want
    assert all(r["n_tokens"] == len(r["ids"]) and r["decoded"] == library.decode(list(r["ids"])) for r in rows)
