"""Language ID, toxicity and licence scan: held-out accuracy, edge cases, brute force."""

import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from eventfold.llm import langid, license_scan, toxicity
from eventfold.llm.common import fold

ROWS = [(1, ""), (2, None), (3, "123 !"), (4, "x"), (4, "x"), (None, "the and of")]


@pytest.fixture(scope="module")
def docs():
    return pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()


def test_language_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(df, fold("doc_id", 4) != 2, rows=400)
    out = langid.identify(df, model).join(df.select("doc_id", "lang"), "doc_id").where(fold("doc_id", 4) == 2)
    assert out.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.97
    odd = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 as score", "2 as key")
    got = {str(r["doc_id"]): (r["lang_pred"], r["score"]) for r in langid.identify(odd, model).collect()}
    assert got["1"] == got["2"] == got["3"] == ("und", 0.0) and got["4"][0] in model.languages and got["None"][0] == "en"
    none = langid.train(df.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {r["lang_pred"] for r in langid.identify(odd, none).collect()} == {"und"}
    assert langid.identify(odd.limit(0), model).count() == 0


def test_codewords_differ():
    for n in (2, 3, 5, 9):
        c = langid.codewords(n)
        assert len({tuple(r) for r in c}) == n and (np.abs(c.sum(0)) < n).all()


def test_toxicity_learns_words_and_their_misspellings(spark):
    rng = np.random.default_rng(0)
    plain = ["thon", "erwh", "anderin", "tionly", "reble", "hationed", "oustea", "wering", "shoren", "ndatly"]
    bad = ["idiot", "moron", "pathetic"]
    make = lambda toxic: " ".join([*rng.choice(plain, 60), *([rng.choice(bad)] * 3 if toxic else [])])
    given = [(i, make(i % 2 == 0)) for i in range(300)]
    df = spark.createDataFrame([*given, *((k + 1000 if k else None, t) for k, t in ROWS)], "doc_id long, text string").selectExpr("*", "7 as score", "8 as key")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in given] + [(None, 1), (5000, None)], "doc_id long, toxic int")
    learn = fold("doc_id", 5) != 0
    model = toxicity.train(df, labels, learn)
    out = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    held = [i for i, _ in given if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(out[i] >= 0.5) == (i % 2 == 0) for i in held]) > 0.95
    assert all(0 <= s <= 1 for s in out.values()) and out[1001] == out[1002] < 0.5
    near = model.scores(["you idiott", "such a morron", "tionly reble"])
    assert near[0] > near[2] and near[1] > near[2]
    alone = toxicity.train(df, labels.limit(0), learn)
    assert (alone.scores(["a", "", None]) < 0.5).all() and toxicity.score(df.limit(0), model).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_licence_places(spark, docs):
    extra = ["CC BY cc-by 4.0, cc\n by!", "accc by", "General  PUBLIC License; general public licenses", "All rights reserved. all rights reserved", "", None, "Licensed under teh Apache Lcense, Version 2.0", "ccé by", "all rihts resrved", "released under the MIT licence"]
    given = [(d["doc_id"], d["text"]) for d in docs] + [(10**6 + i, t) for i, t in enumerate(extra)]
    df = spark.createDataFrame(given, "doc_id long, text string").selectExpr("*", "1 as n_words", "2 as matches")
    got = {r["doc_id"]: r for r in license_scan.scan(df).collect()}
    phrases = [(n.label, n.words.split()) for n in license_scan.BASE]
    for i, t in given:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        want = sorted((k, label) for label, p in phrases for k in range(len(w)) if w[k : k + len(p)] == p)
        assert got[i]["n_words"] == len(w)
        assert sorted((m["first_word"], m["label"]) for m in got[i]["matches"] if m["base"]) == want
    label = lambda k: {(m["label"], m["errors"]) for m in got[10**6 + k]["matches"] if not m["base"]}
    assert ("apache-2.0", 3) in label(6) and {x for x, _ in label(6)} == {"apache-2.0"} and ("reserved", 2) in label(8) and ("mit", 1) in label(9) and not label(4)


def test_edited_notices_before_better_ones():
    from eventfold.llm.license_scan import BASE, NOTICES, Scanner

    scanner = Scanner()
    reserved = len(BASE) + next(i for i, n in enumerate(NOTICES) if n.words == "all rights reserved")
    exact, edited = "all rights reserved", "all rights reservd"
    for order in ([edited, exact], [edited, edited, exact], [exact, edited, exact], [edited, exact, edited], [edited] * 3 + [exact] * 3):
        got = [(e, n) for i, _, e, n in scanner.matches(f" {' '.join(order)} ") if i == reserved]
        assert [n for _, n in got] == [int(x == edited) for x in order], order
        ends = [len(" ".join(order[: k + 1])) + 1 for k in range(len(order))]
        assert all(abs(e - x) <= 1 for (e, _), x in zip(got, ends, strict=True))


def edits(a, b):
    """Least insertions, deletions and replacements that turn a into b."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_every_edited_notice_is_found():
    """Notices with as many edits as they may have, at any place, are found with a span that
    stands in the text and has no more edits than it reports."""
    from eventfold.llm.license_scan import BASE, NOTICES, Scanner

    scanner, rng = Scanner(), np.random.default_rng(3)
    for i, notice in enumerate(NOTICES):
        for _ in range(8):
            words = list(notice.words)
            for _ in range(rng.integers(0, notice.k + 1)):
                at = int(rng.integers(0, len(words)))
                words[at : at + 1] = [[], ["z"], [words[at], "q"]][rng.integers(0, 3)]
            text = " thon erwh " + "".join(words) + " reble ing "
            text = re.sub(" +", " ", text)
            if edits("".join(words), notice.words) > notice.k or "".join(words) not in text:
                continue
            found = [(s, e, n) for k, s, e, n in scanner.matches(text) if k == len(BASE) + i]
            assert found and all(edits(text[s:e], notice.words) <= n <= notice.k for s, e, n in found), (notice, text)


def test_very_long_texts(spark):
    """One text of millions of characters gives what its definition says; the other operators are in
    `test_edges` and `test_corpus`."""
    from eventfold.llm import minhash_join, syncmers

    long = "word and another one here " * 120_000 + "all rights reserved"
    df = spark.createDataFrame([(1, long), (2, long + " more"), (3, "short text")], "doc_id long, text string")
    row = {r["doc_id"]: r for r in license_scan.scan(df).collect()}[1]
    assert row["n_words"] == 600_003 and [m["first_word"] for m in row["matches"] if m["base"]] == [600_000]
    near = {r["doc_id"]: r["component_id"] for r in minhash_join.near_duplicates(df).collect()}
    assert near[3] == 3 and near[1] == 1
    found = {r["doc_id"]: r for r in syncmers.compare_with_edits(df).collect()}
    assert found[1]["n_chars"] == len(long) and found[1]["near_next"] > 0.99
    model = toxicity.ToxicityModel(np.zeros(toxicity.BUCKETS), -1.0)
    assert np.allclose(model.scores([long]), model.scores(["word and"]))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert langid.train(docs, F.lit(True), rows=200).predict([long])[0] == ["en"]


def test_one_key_with_most_rows_leaves_the_samples_bounded(spark):
    docs = spark.createDataFrame([(7, f"text number {i} and the", "en") for i in range(3000)] + [(i + 100, f"le la et que {i} les", "fr") for i in range(50)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(7, 1)] + [(i + 100, 0) for i in range(50)], "doc_id long, toxic int")
    counted = []
    real = toxicity.fit
    try:
        toxicity.fit = lambda y, cut: counted.append(len(y)) or real(y, cut)
        toxicity.train(docs, labels, F.lit(True))
    finally:
        toxicity.fit = real
    assert counted == [51]
    model = langid.train(docs.withColumn("doc_id", F.lit(None).cast("long")), F.lit(True), rows=40)
    assert model.languages == ["en", "fr"] and model.predict(["le la et que", "text number and the"])[0] == ["fr", "en"]


def exhaustive(scanner, i, words):
    """The best match of all the text, then that of what is left beside it, and so on."""
    (whole, pattern), k = scanner.patterns[i], scanner.notices[i].k
    open_, out = [(0, len(words))], []
    while True:
        best = min(((sum(m.fuzzy_counts), m.start(), m.end(), w) for w in open_ if w[1] - w[0] >= len(whole) - k and (m := pattern.search(words, *w))), default=None)
        if best is None:
            return sorted(out)
        errors, start, stop, w = best
        out.append((i, start, stop, errors))
        open_.remove(w)
        open_ += [(w[0], start), (stop, w[1])]


def edits(text, whole):
    """Least edits of `whole` to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(whole, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(last + (c != d), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_licence_spans_by_exhaustive_search():
    from eventfold.llm.license_scan import Scanner, plain

    scanner, rng = Scanner(), np.random.default_rng(7)
    fuzzy = [i for i, n in enumerate(scanner.notices) if n.k]
    letters = list("abcdefghijklmnopqrstuvwxyz ")
    for n in range(120):
        parts = []
        for _ in range(rng.integers(1, 5)):
            words = list(scanner.notices[rng.choice(fuzzy)].words)
            for _ in range(rng.integers(0, 8)):
                at, kind = rng.integers(0, len(words)), rng.integers(0, 3)
                words[at : at + int(kind != 1)] = [rng.choice(letters)] * int(kind != 2)
            cut = rng.integers(0, 12)
            parts.append("".join(words)[cut if n % 3 == 0 else 0 :])
        text = plain(" ".join(parts))
        got = scanner.matches(text)
        for i in fuzzy:
            own = [m for m in got if m[0] == i]
            assert own == exhaustive(scanner, i, text), (scanner.notices[i], text)
            assert bool(own) == (edits(text, scanner.patterns[i][0]) <= scanner.notices[i].k)


@pytest.mark.parametrize("line", ["software is provided ", "under the license of the ", "permission is hereby granted free of charge to any person obtaining a copy of this software ", "the software is provided as was without warranty of any kind "])
def test_licence_scan_of_repeated_words(line):
    import time

    from eventfold.llm.license_scan import Scanner, plain

    scanner, words = Scanner(), plain(line * (100_000 // len(line)))
    began = time.thread_time()
    found = scanner.matches(words)
    assert time.thread_time() - began < 1.5
    assert all(a[2] <= b[1] for a, b in zip(found, found[1:], strict=False) if a[0] == b[0])


def test_windows_cut_on_executors(spark):
    """The same windows, in the same order, as of texts that are held."""
    rng = np.random.default_rng(5)
    texts = {int(k): " ".join(rng.choice(["a", "word", "idiot", "x1", "É"], rng.integers(0, 40))) for k in rng.permutation(60)}
    df = spark.createDataFrame(list(texts.items()), "key long, text string").repartition(4)
    model = toxicity.ToxicityModel(rng.normal(0, 1, toxicity.BUCKETS), 0.1)
    keys = sorted(texts)
    cut = toxicity.cut_on_executors(df, keys)
    for which, most in ((None, 4), (np.array([3, 7, 8]), 10**9), (None, 1)):
        each = [toxicity._cut(model, [texts[keys[i]]], most) for i in (range(60) if which is None else which.tolist())]
        want = [w for x in each for w in x[0]], np.repeat(np.arange(len(each)), [len(x[0]) for x in each]), np.concatenate([x[2] for x in each])
        got = cut(model, which, most)
        again = toxicity.cut_on_executors(df.repartition(2), keys)(model, which, most)
        assert got[0] == again[0] and np.array_equal(got[2], again[2])
        assert got[0] == want[0] and got[1].tolist() == want[1].tolist() and np.array_equal(got[2], want[2])
