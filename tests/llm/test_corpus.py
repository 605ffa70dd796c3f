"""Collocations, importance resampling and quality rules, by brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from eventfold.llm import collocations, importance, quality_rules
from eventfold.llm.byte_words import LETTERS, PHRASES, cut

LOWER = {c: c + 32 for c in range(65, 91)}


def pieces_of(text):
    return [[w for w in re.split(r"[\x20\x09]+", p) if w] for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]


def letters_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


ODD = [None, "", " \t", "...", "A\0b c\x01d", "Ünïcödé É9-x é", "a.b c\nd\x0be", "word " * 50_000, "　wide　  ", "x" * 200_000]


def test_cut_words():
    for given in (ODD, [], [None], ["one"], ["", "b a"], ["a b", "", "c"]):
        for table, parts in ((PHRASES, pieces_of), (LETTERS, lambda t: [letters_of(t)])):
            words, text, first, counts = cut(given, table)
            spelled = [w.as_py().decode() for w in words]
            want = [[w for w in piece] for t in given for piece in parts(t) if piece]
            assert spelled == [w for piece in want for w in piece]
            assert counts.tolist() == [sum(map(len, parts(t))) for t in given]
            assert text.tolist() == [i for i, t in enumerate(given) for piece in parts(t) for _ in piece]
            if table is PHRASES:
                assert first.tolist() == [k == 0 for piece in want for k in range(len(piece))]


def mined(rows, least, longest, covered=100, deepest=2000):
    totals, f = Counter(), Counter()
    for lang, text in rows:
        for p in pieces_of(text):
            totals[lang or "und"] += len(p)
            for k in range(1, longest + 1):
                for i in range(len(p) - k + 1):
                    f[lang or "und", tuple(p[i : i + k])] += 1
    candidates = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    inside = lambda x, y: any(y[i : i + len(x)] == x for i in range(len(y) - len(x) + 1))
    by = defaultdict(list)
    for (lang, g), a in candidates.items():
        if any(la == lang and len(h) > len(g) and 100 * b >= covered * a and inside(g, h) for (la, h), b in candidates.items()):
            continue
        n = totals[lang]
        score, k = min((1000 * a * n // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g)))
        by[lang].append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]], n))
    return sorted((lang, rank, p.decode(), -a, l, r, n, -s) for lang, found in by.items() for rank, (s, a, p, l, r, n) in enumerate(sorted(found)[:deepest], 1))


@pytest.mark.parametrize(("least", "slices", "covered"), [(5, 10**6, 100), (3, 7, 100), (4, 10**6, 60)])
def test_collocations(spark, monkeypatch, least, slices, covered):
    monkeypatch.setattr(collocations, "SLICE", slices)
    rng = random.Random(11)
    words = ["a", "B", "c", "dé", "É", "new", "York", "zz9", "é"]
    rows = []
    for k in range(150):
        text = " ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".", "\n", "\t"]) for _ in range(rng.randint(0, 25)))
        if k % 3 == 0:
            text += " the quick  brown\tfox jumps over"
        rows.append((rng.choice(["en", "de", None, "und"]), text))
    rows += [("en", None), ("en", ""), *rows[:20]]
    df = spark.createDataFrame([(lang, t, "x", 1, 2) for lang, t in rows], "lang string, text string, phrase string, n int, id int").repartition(5)
    got = sorted(tuple(r) for r in collocations.mine(df, least=least, covered=covered).collect())
    assert got == mined(rows, least, 5, covered)
    assert {r[1] for r in got} >= {1} and len(got) > 30


def test_collocations_of_little(spark):
    df = spark.createDataFrame([("en", t) for t in ODD], "lang string, text string")
    assert [tuple(r) for r in collocations.mine(df, longest=3).collect()] == [x for x in mined([("en", t) for t in ODD], 100, 3)]
    assert collocations.mine(df.limit(0)).count() == 0
    assert collocations.mine(spark.createDataFrame([("en", "a b c")], "lang string, text string")).dtypes == collocations.mine(df).dtypes
    ties = [("en", "b a, d c, f e, a a a a")] * 3
    got = [tuple(r) for r in collocations.mine(spark.createDataFrame(ties, "lang string, text string"), least=2, deepest=2).collect()]
    assert sorted(got) == mined(ties, 2, 5, deepest=2)


def test_exact_scores(spark):
    """Products beyond 64 bits, and cuts that tie once rounded."""
    a, total, heads, tails = 3 * 10**15, 9 * 10**15 - 1, [4 * 10**15 + 1, 35 * 10**14], [5 * 10**15, 3 * 10**15 + 1]
    df = spark.createDataFrame([(heads, tails, a, total)], "heads array<long>, tails array<long>, n long, total long")
    r = df.select(collocations.lowest_cut(df.total).alias("x")).first()["x"]
    both = [1000 * a * total // (heads[k] * tails[1 - k]) for k in range(2)]
    assert (int(r["score"]), r["cut"]) == min(zip(both, (1, 2), strict=True))
    df = spark.createDataFrame([([101, 102], [102, 101], 100, 1)], "heads array<long>, tails array<long>, n long, total long")
    assert df.select(collocations.lowest_cut(df.total).alias("x")).first()["x"]["cut"] == 1


def drawn(rows, target, most, buckets, least, percent, seed):
    def features(t):
        w = letters_of(t)
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, most + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    total_s, total_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * total_s / ((s[b] + 1) * total_t)))
    scored = []
    for key, text in rows:
        n, found = features(text)
        weight = sum(map(gain, found))
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        scored.append((key, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in scored if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[3]))
    ranks = {id(r): k for k, r in enumerate(able[: percent * len(able) // 100], 1)}
    return Counter((*r, ranks.get(id(r))) for r in scored)


@pytest.mark.parametrize(("most", "buckets", "nodes"), [(1, 10_000, 500_000), (3, 50, 20)])
def test_importance(spark, monkeypatch, most, buckets, nodes):
    monkeypatch.setattr(importance, "NODES", nodes)
    rng = random.Random(12)
    text = lambda: " ".join(rng.choice("alpha Beta gamma délta 9x ÉÉ w1 w2 w3".split()) + rng.choice(["", "-", "\n"]) for _ in range(rng.randint(0, 40)))
    rows = [(k, text()) for k in range(200)] + [(1000 + k, t) for k, t in enumerate(ODD)] + [(None, "a " * 30), (5, "b " * 25), (5, "b " * 25), (6, None)]
    target = [text() for _ in range(9)] + [None, ""]
    df = spark.createDataFrame([(k, t, "x", 3) for k, t in rows], "doc_id long, text string, score string, weight int").repartition(4)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(df, goal, most=most, buckets=buckets, percent=30)
    assert Counter(tuple(r) for r in got.collect()) == drawn(rows, target, most, buckets, 20, 30, 2024)
    assert importance.resample(df.limit(0), goal).count() == 0
    alone = importance.resample(df, goal.limit(0), most=most, buckets=buckets, percent=30)
    assert Counter(tuple(r) for r in alone.collect()) == drawn(rows, [], most, buckets, 20, 30, 2024)


def test_a_full_trie_begins_anew():
    words, text, _, _ = cut(["a b a b c", "b a"], LETTERS)
    trie = importance.Trie(7)
    for nodes in trie.walk(words, text, 2):
        trie.count(nodes)
    want = Counter()
    for g in ("a", "b", "a", "b", "c", "a b", "b a", "a b", "b c", "b", "a", "b a"):
        want[zlib.crc32(g.encode()) % 7] += 1
    assert {k: n for k, n in enumerate(trie.totals().tolist()) if n} == want
    assert len(trie) == 1 + 3 + 3


def said(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def normal(text):
    found = [re.sub(r"[\x20\x09\x0B-\x0D]+", " ", re.sub("[0-9]+", "0", x.lower())).strip(" ") for x in (text or "").split("\n")]
    return [x for x in found if x]


def judged(rows):
    texts = {(host, text or "") for _, host, text in rows}
    having, hosts = Counter(), Counter()
    for host, text in texts:
        hosts[host] += 1
        having.update((host, x) for x in set(normal(text)))
    frequent = {k for k, n in having.items() if n > quality_rules.LEAST_TEXTS and 100 * n > quality_rules.MOST_SHARE * hosts[k[0]]}
    out = Counter()
    for key, host, text in rows:
        facts = said(text)
        failed = facts[0] < 20 or 100 * facts[4] > 30 * facts[0]
        chars = sum(map(len, normal(text)))
        left = sum(len(x) for x in normal(text) if (host, x) not in frequent)
        out[key, *facts, failed, chars, left, not failed and 100 * left >= 30 * chars] += 1
    return out


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_quality_rules(spark, monkeypatch, broadcast):
    monkeypatch.setattr(quality_rules, "BROADCAST_LINES", broadcast)
    rng = random.Random(13)
    line = lambda n: " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(n))
    rows, key = [], 0
    for host in ("a", "b", None):
        shared = [f"Click HERE {host} to read 12 more pages", "All rights", line(30)]
        for k in range(60):
            text = [line(rng.randint(0, 12)) for _ in range(rng.randint(0, 6))]
            if k % 4 == 0:
                text.insert(0, shared[0].replace("12", str(k)) + " " * (k % 3))
            if k % 4 == 1:
                text = [shared[2].upper() if k % 8 == 1 else shared[2], *text[:1]]
            if k % 7 == 0:
                text += text[:2] * 2
            rows.append((key, host, "\n".join(text)))
            key += 1
    copied = "\n".join(line(9) for _ in range(4))
    rows += [(key + k, "a", copied) for k in range(40)]  # copies alone make no line frequent
    rows += [(2000 + k, "a", t) for k, t in enumerate(ODD)] + [(None, "a", "x $ # y"), (7, "a", rows[7][2]), (None, None, None), rows[3], rows[3]]
    rows += [(3000, "a", "one two three four five six seven eight " * 3), (3001, "b", "a b\n\na b\r\na b\x0b\n \na b"), (3002, "b", " ".join(map(str, range(5000))) + " " + " ".join(map(str, range(2000))))]
    df = spark.createDataFrame([(k, h, t, 5, "x") for k, h, t in rows], "doc_id long, source string, text string, n_words int, line string").repartition(4)
    got = Counter(tuple(r) for r in quality_rules.judge(df).collect())
    want = judged(rows)
    assert got == want
    assert any(r[8] != r[7] and r[9] for r in got) and any(not r[6] and not r[9] for r in got)
    assert quality_rules.judge(df.limit(0)).count() == 0


def test_quality_rules_stay_native(spark, sf_dir):
    from eventfold.llm.queries import op13_quality

    plan = op13_quality(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(k in plan for k in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_gains_round_down():
    one = np.zeros(3, np.int64)
    frame = lambda n: type("F", (), {"collect": lambda self: [{"bucket": k, "n": x} for k, x in enumerate(n)]})()
    got = importance.gains(frame([9, 0, 1]), frame([0, 4, 1]), 3)
    assert got.tolist() == [math.floor(1000 * math.log(x)) for x in ((1 * 13) / (10 * 8), (5 * 13) / (1 * 8), (2 * 13) / (2 * 8))]
    assert one.sum() == 0
