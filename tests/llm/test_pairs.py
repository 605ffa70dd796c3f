"""Near duplicates, embeddings, components, mixing, syncmers and the pipeline, by brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from eventfold.llm import embedding_dedup, minhash_join, mixing, syncmers
from eventfold.llm.components import components


def joined(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("links", [[], [(1, 1)], [(2, 1), (1, 2), (3, 2)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 30)], [(a * 7 % 50, a * 11 % 50) for a in range(40)]])
def test_components(spark, links):
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for p in links if p[0] != p[1] for x in p}
    assert got == joined(nodes, [p for p in links if p[0] != p[1]])


def shingled(text, n):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if w]
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(minhash_join, "BLOCK", 8)
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    base = [" ".join(word() for _ in range(rng.randint(30, 90))) for _ in range(12)]
    rows = []
    for b in base:
        for _ in range(12):
            w = b.split(" ")
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w))
    rows += rows[:20] + [rows[0].upper(), "", None, " \n", "one two", "One  two", "one two three four five", "x" * 500]
    given = list(enumerate(rows)) + [(None, rows[0]), (3, rows[3])]
    rng.shuffle(given)
    df = spark.createDataFrame(given, "doc_id long, text string").selectExpr("*", "1 as node", "2 as n", "3 as id", "'x' as component").repartition(5)
    for words in (4, 5):
        got = defaultdict(set)
        for r in minhash_join.near_duplicates(df, words=words).collect():
            got[r["doc_id"]].add((r["n_shingles"], r["component_id"], r["kept"]))
        sets = {i: shingled(t, words) for i, t in enumerate(rows)}
        links = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
        want = joined(sets, links)
        for i in sets:
            assert got[i] == {(len(sets[i]), want[i], want[i] == i)}, i
        assert got[None] == {(len(sets[0]), None, True)}
    assert minhash_join.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("words", [4, 5])
def test_slices_of_few_words(spark, words):
    for n in range(7):
        text = " ".join("abcdefg"[:n])
        for given in ([text], [text, None], ["", text]):  # alone, as in a slice of their own
            found, starts = minhash_join.shingles(given, words)
            assert len(found) == starts[-1] == len(shingled(text, words)) and len(set(found.tolist())) == len(found)
            apart = minhash_join.shingles([*given, "long " * 20], words)[0][: len(found)]
            assert found.tolist() == apart.tolist()
    rows = [(1, "one two"), (2, "x " * 300_000), (3, "one two"), (4, "one two three"), (5, "One two  three")]
    got = minhash_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), words=words).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == [(1, 1, 1), (2, 1, 2), (3, 1, 1), (4, 1, 4), (5, 1, 4)]


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(30, 24))
    x = [(c + rng.normal(size=24) * rng.choice([0.0, 0.05, 0.12])).tolist() for c in centers for _ in range(12)]
    rows = [(i, v, int(i % 3 == 0)) for i, v in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * 24, 1), (902, [float("nan")] * 24, 1), (903, [None, 1.0], 1), (904, x[0], None), (905, [], 1), (906, [1.0, float("inf")], 0), (None, x[0], 1), (907, [2.0, 0.0], 1), (908, [4.0, -0.0], 1), (909, [5e-320, 0.0], 1)]
    rows = [(i, v, l) for i, v, l in rows if i != 909]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as id", "2 as node", "3 as n")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect()}
    sound = {i: (np.array(v), l) for i, v, l in rows if i is not None and (i < 900 or i in (907, 908))}
    links = [(i, j) for i, (v, l) in sound.items() for j, (w, m) in sound.items() if i < j and l == m and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98]
    want = joined([i for i, _, _ in rows if i is not None], links)
    count = defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    assert sum(got[i][0] for i in sound) >= 0.99 * sum(count.values()) and all(got[i][0] <= count[i] for i in sound)
    wrong = [i for i in want if got[i] != (count[i], want[i], want[i] == i)]
    assert len(wrong) <= 2 and got[None] == (0, None, True)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_of_any_size_and_repeated_ids(spark):
    rows = [(1, [1e200, 2e200], 1), (2, [2e200, 4e200], 1), (3, [1e-200, 2e-200], 1), (4, [5e-324, 1e-323], 1), (5, [1.7e308, -1.7e308], 1)]
    rows += [(6, [0.0, 1.0], 2), (6, [1.0, 0.001], 2), (7, [1.0, 0.0], 2), (8, [0.001, 1.0], 2), (6, [0.0, 1.0], 2), (9, [-1.0, 0.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect())
    want = [(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 3, 1, False), (5, 0, 5, True)]
    # (0, 1) twice and (0.001, 1); (1, 0.001) and (1, 0): both groups have 6 as their least id.
    want += [(6, 2, 6, True), (6, 2, 6, True), (8, 2, 6, False), (6, 1, 6, True), (7, 1, 6, False), (9, 0, 9, True)]
    assert got == sorted(want)


@pytest.mark.parametrize("width", [3, 4, 8, 64, 384, 1024])
def test_recall_of_buckets(width):
    """Pairs at exactly the least cosine meet in some table, however many hashes a bucket has."""
    rng = np.random.default_rng(width)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    a = unit(rng.normal(size=(200, width)))
    z = rng.normal(size=a.shape)
    z = unit(z - (z * a).sum(1, keepdims=True) * a)
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * z
    for hashes in range(2, embedding_dedup.hashes_for(10**15, width) + 1):
        x, y = embedding_dedup.buckets(a, hashes=hashes), embedding_dedup.buckets(b, hashes=hashes)
        assert ((x[:, :, :1] == y) | (y[:, :, :1] == x)).any((1, 2)).mean() >= 0.98
    assert embedding_dedup.hashes_for(1, 64) == 2 < embedding_dedup.hashes_for(10**9, 64)


def test_targets():
    got = mixing.targets([("b", 100), ("a", 100), (None, 100), ("c", 0)])
    assert got == {"a": 187.5, "b": 75.0, "c": 0.0, None: 187.5}
    assert mixing.targets([("a", 10), ("b", 1000)]) == {"a": 20.0, "b": 1495.0}
    assert mixing.targets([]) == {} and mixing.targets([("x", 10)]) == {"x": 15.0}


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 50)
    rng = random.Random(4)
    rows = [(i, rng.choice(["s1", "s2", "s3", "s3", "s3", None]), " ".join(["w"] * int(rng.paretovariate(0.8)))) for i in range(700)]
    rows += [(800, "s1", None), (801, "s1", " \t"), (7, "s2", "a b"), (7, "s2", "a b"), (None, "s9", "x y z")]
    rows += [(None, "s1", "q " * 9)] * 300 + [(900, None, "same words here")] * 500
    monkeypatch.setattr(mixing, "CHUNK", 16)
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as size", "2 as target", "3 as block")
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    again = mixing.mix(df.repartition(7)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, out)) == sorted(map(key, again))
    by = defaultdict(list)
    for r in out:
        assert (r["size"] > 0 or r["copies"] == 0) and r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"] + r["part"]
        by[r["source_size"], r["target"]].append(r)
    for (size, target), part in by.items():
        assert sum(r["size"] for r in part) == size and abs(sum(r["taken"] for r in part) - target) <= 1 and sum(r["part"] > 0 for r in part) <= 1
    assert mixing.mix(df.limit(0)).count() == 0


def ordered(rows):
    """Each row with the next one, ascending by id, null ids first; of equal ids in any order."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    return list(zip(order, order[1:] + order[:1], strict=True))


@pytest.mark.parametrize("together", [4, 1024])
@pytest.mark.parametrize("kind", ["plain", "wide", "outlier", "null", "one text", "copies", "few"])
def test_next_documents(spark, monkeypatch, together, kind):
    monkeypatch.setattr(syncmers, "TOGETHER", together)
    low, high = -(2**63), 2**63 - 1
    n = 2 if kind == "few" else 120
    rng = random.Random(9)
    ids = {"plain": list(range(n)), "wide": [low, low + 1, 0, high - 1, high, *(rng.randrange(low, high) for _ in range(n))], "outlier": [*range(n), high], "null": [None] * n, "one text": [7] * n, "copies": list(range(n)) + [30] * 40, "few": [5, 3]}[kind]
    rng.shuffle(ids)
    rows = [(i, "t" if kind == "one text" else f"text {i}" if kind == "copies" else f"{k}") for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as range", "2 as at", "3 as tie", "4 as end").repartition(3)
    out = [(r["doc_id"], r["text"], r["next_text"]) for r in syncmers.with_next(df).collect()]
    if kind in ("null", "one text"):  # one cycle through all rows
        assert len(out) == n and Counter(t for _, t, _ in out) == Counter(t for _, _, t in out) == Counter(t for _, t in rows)
        after, at, seen = {t: u for _, t, u in out}, "0", set()
        while kind == "null" and at not in seen:
            seen.add(at)
            at = after[at]
        assert kind != "null" or len(seen) == n
    else:
        assert sorted(out) == sorted((i, t, u) for (i, t), (_, u) in ordered(rows))


def test_syncmers(spark):
    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 12))) for _ in range(n))
    rows = [(i * (1 if i < 50 else 1000), text(rng.randint(1, 200))) for i in range(80)] + [(5, "same"), (5, "same"), (60, "same"), (200_000, ""), (200_001, None), (None, "no id"), (-7, "é" * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as bucket", "2 as own", "3 as n", "4 as next")
    out = syncmers.compare_with_edits(df).collect()
    assert len(out) == len(rows)
    want = defaultdict(list)
    for (i, t), (_, u) in ordered(rows):
        t, u = t or "", u or ""
        want[i].append(t[: len(t) - len(t) // 4] + u[: len(t) // 4])
    for r in out:
        assert r["edited"] in want[r["doc_id"]] or r["doc_id"] == 5
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
    long = [r for r in out if r["n_chars"] > 400]
    assert np.mean([r["near_edited"] for r in long]) > 0.6 and max(r["near_next"] for r in long) < 0.2
    same = {r["fingerprint"] for r in out if r["n_chars"] == 4}
    assert len(same) == 1 and {r["fingerprint"] for r in out if r["n_chars"] == 0} == {""}
    one = syncmers.compare_with_edits(df.where("doc_id = 1")).first()
    assert one["near_next"] == 1.0 and syncmers.compare_with_edits(df.limit(0)).count() == 0


def closed_syncmers(text):
    """(number of the first symbol, hash) of all anchors, by the definition: four symbols whose
    least inner pair is the first or the last of the three."""
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    of = lambda data, seed: signed(xxhash.xxh64_intdigest(data, seed % 2**64))
    pair = lambda a, b: of(b.to_bytes(8, "little", signed=True), of(a.to_bytes(8, "little", signed=True), 42))
    symbols = [of(w.encode(), 42) for run in re.findall(r"[^ \t\n\x0b\f\r]+", text) for w in ([run] if len(run) <= 32 else run)]
    if not symbols:
        return []
    padded = [0, 0, 0, *symbols, 0, 0, 0]
    out = []
    for i in range(len(padded) - 3):
        inner = [pair(padded[i + k], padded[i + k + 1]) for k in range(3)]
        if min(inner) in (inner[0], inner[2]):
            out.append((i - 3, pair(inner[0], inner[2])))
    return out


def test_anchors_by_brute_force(spark):
    rng = random.Random(11)
    given = ["", None, " \n\t", "a", "a b", "one two three four five", "é" * 30, "x " * 50, "y" * 32, "a " + "z" * 33, "𝒳" * 40 + " 𝒳", "中文没有空格" * 9 + " 也有 word", "\u3000 wide\u00a0blank", *("".join(rng.choice("ab cdé\n") for _ in range(rng.randint(0, 300))) for _ in range(30))]
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for r in df.select("doc_id", syncmers.anchors(F.col("text")).alias("a"), syncmers.hashes(F.col("text")).alias("h")).collect():
        want = closed_syncmers(given[r["doc_id"]] or "")
        assert [(x["at"], x["hash"]) for x in r["a"]] == want and r["h"] == [h for _, h in want]


def test_anchors_of_unspaced_text(spark):
    """One character put before, into or taken out of 4,000 characters without blanks moves few."""
    rng = random.Random(12)
    for letters in ("abcdefghij0123456789/", "的一是在不了有和人这中大为上个国"):
        run = "".join(rng.choice(letters) for _ in range(4000))
        given = [run, "Q" + run, run[:1999] + "Q" + run[1999:], run[:700] + run[701:], "before " + run, run[:2000]]
        rows = spark.createDataFrame([(t,) for t in given], "t string").select("t", syncmers.numbered(syncmers.hashes(F.col("t"))).alias("a"))
        found = {r["t"]: (r["a"], r["f"]) for r in rows.select("t", "a", syncmers.fingerprint(F.col("a")).alias("f")).collect()}
        own = set(found[run][0])
        for t in given[1:5]:
            other = set(found[t][0])
            assert 2 * len(own & other) / (len(own) + len(other)) > 0.98 and found[t][1] != found[run][1]
        assert len(set(found[given[5]][0]) - own) <= 3


def test_syncmers_count_all_anchors(spark):
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8))) for _ in range(n))
    passage = text(60)
    pair = [f"{text(9000)} {passage} {text(10940)}", f"{text(15000)} {passage} {text(4940)}"]
    line = "the same line of ten words stands here again and "
    rows = list(enumerate([*pair, line * 300, text(400), "a b c d", "a b c d " * 3, ""]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in syncmers.compare_with_edits(df).collect()}
    found = {r["doc_id"]: [x["hash"] for x in r["a"]] for r in df.select("doc_id", syncmers.anchors(F.col("text")).alias("a")).collect()}
    edits = spark.createDataFrame([(k, r["edited"]) for k, r in out.items()], "doc_id long, text string")
    changed = {r["doc_id"]: [x["hash"] for x in r["a"]] for r in edits.select("doc_id", syncmers.anchors(F.col("text")).alias("a")).collect()}

    def share(a, b):
        return 2 * (Counter(a) & Counter(b)).total() / (len(a) + len(b)) if a or b else 1.0

    for k in found:
        assert out[k]["near_next"] == pytest.approx(share(found[k], found[(k + 1) % len(found)]))
        assert out[k]["near_edited"] == pytest.approx(share(found[k], changed[k]))
        assert len(out[k]["fingerprint"]) == (32 if found[k] else 0)
    named = [(sorted(x), f) for k in found for x, f in ((found[k], out[k]["fingerprint"]), (changed[k], out[k]["edited_fingerprint"]))]
    assert all((a == b) == (f == g) for a, f in named for b, g in named)
    assert 0.001 < out[0]["near_next"] < 0.01
    assert out[2]["near_edited"] > 0.7


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and out.count() > 0, name
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").columns == ["doc_id", "n_tokens", "ids", "decoded"]
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", None, 0), (None, "a b c", None, "s", 5), (3, "a b c", "fr", "s", 5), (3, "a b c", "fr", "s", 5), (4, "99", "fr", "s", 2)], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        odd = stage(spark, odd, "/root/testdata/sf0.001")
    assert {r["doc_id"] for r in odd.collect()} <= {None, 3}


def test_deduplicate_stage_by_brute_force(spark):
    import corpus_pipeline

    rng = random.Random(13)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40))
    base = [text() for _ in range(8)]
    near = [f"{b} tail" for b in base[:4]]
    rows = [(3, base[0]), (5, base[0]), (5, base[1]), (None, base[1]), (None, base[2]), (None, base[2]), (7, near[0]), (7, near[0]), (8, near[3]), (9, base[3]), (10, None), (10, None), (11, ""), (12, base[4]), (12, base[5]), (13, "too few"), (13, "too  FEW")]
    schema = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], schema).repartition(3)
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.deduplicate(spark, df, "").collect())
    sets = [shingled(t, 5) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    groups = defaultdict(list)
    for i, g in joined(range(len(rows)), links).items():
        groups[g].append(rows[i])
    least = [min(((i is None, i or 0) for i, _ in g)) for g in groups.values()]
    assert sum(got.values()) == len(groups) and set(got) <= set(rows)
    assert sorted((i is None, i or 0) for i, _ in got.elements()) == sorted(least)


def test_mix_stage_draws_each_row(spark):
    import corpus_pipeline

    schema = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema
    rows = [(k % 40 or None, " ".join(["w"] * (k % 17)), "en", ("a", "b", None)[k % 3], 0) for k in range(900)]
    df = spark.createDataFrame(rows, schema)
    out = corpus_pipeline.mix(spark, df, "").collect()
    want = mixing.targets([(s, sum(len(t.split()) for _, t, _, x, _ in rows if x == s)) for s in ("a", "b", None)])
    for s, target in want.items():  # in whole copies: within one document of the target
        assert abs(sum(len(r["text"].split()) for r in out if r["source"] == s) - target) <= 17
    assert all(r["text"] for r in out) and {r["doc_id"] for r in out} == {r[0] for r in rows if r[1]}


def test_language_stage_rejects_by_the_codewords(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = [(10**6, "こんにちは世界 " * 20), (10**6 + 1, "12 %% 34 " * 30), (10**6 + 2, None), (10**6 + 3, "zzxq qqqz zzqx " * 30), (10**6 + 4, "and")]
    more = docs.union(spark.createDataFrame([(i, t, None, None, 0) for i, t in odd], docs.schema))
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, more, "").select("doc_id").collect()}
    assert {i for i in kept if i >= 10**6} == {10**6 + 4}
    clean = [r["doc_id"] for r in docs.where("lang is not null and length(text) > 200").select("doc_id").collect()]
    assert len(kept & set(clean)) >= 0.999 * len(clean)
