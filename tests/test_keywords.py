"""Many words looked up at once, and the lists of runs that tasks make."""

import random

import pyarrow as pa
import pytest

from eventfold.operators import keywords, library
from eventfold.plans import roundtrips
from eventfold.sources.store import Scratch


def test_each_table_is_read_once_for_all_words(spark, sf_dir):
    found = roundtrips.keyword_index(spark, sf_dir)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 6 < len(roundtrips.WORDS)
    assert found.count() == found.distinct().count() > 0


def text(rng):
    return "".join(rng.choice(["a", "b", "c", "é", "𝒳", "门口积", " ", "x y", "\x00"]) for _ in range(rng.randint(0, 12)))


@pytest.mark.parametrize("size", [1, 40, 1 << 21])
def test_lists_of_runs(size):
    rng = random.Random(size)
    ids = sorted(rng.choice([1, 2, 65_535, 65_536, 2**33, 2**33 + 1]) for _ in range(60))
    rows = [(i, [text(rng) for _ in range(rng.randint(0, 4))]) for i in ids]
    rows.append((9, [""]))
    rows.append((10, ["".join(map(chr, range(0x4E00, 0x9000)))]))
    schema = pa.schema([("event_id", pa.int64()), ("texts", pa.list_(pa.string()))])
    batches = [pa.RecordBatch.from_pylist([{"event_id": i, "texts": t} for i, t in rows[k : k + 7]], schema) for k in range(0, len(rows), 7)]
    got = set()
    for batch in keywords._lister(size)(b.slice(1) if k == 1 else b for k, b in enumerate(batches)):
        for r in batch.to_pylist():
            assert r["events"] == sorted(set(r["events"]))
            got |= {(r["run"], (r["chunk"] << keywords.CHUNK) + e) for e in r["events"]}
    assert got == {(t[k : k + 3], i) for i, texts in rows[:7] + rows[8:] for t in texts for k in range(len(t) - 2)}


def test_many_characters_and_events():
    """A slice whose runs and events don't go into one number is halved."""
    rng, n = random.Random(3), 3000
    wide = [chr(rng.randrange(0x20000, 0x2FFFF)) for _ in range(40_000)] + [chr(c) for c in range(0x4E00, 0x4E00 + 20_000)]
    wide += [chr(c) for c in range(0x10000, 0x10000 + 60_000)] + [chr(c) for c in range(0x30000, 0x30000 + 3 * 60_000)]
    texts = [[("".join(wide[k * 100 : k * 100 + 100]))] for k in range(n)]
    schema = pa.schema([("event_id", pa.int64()), ("texts", pa.list_(pa.string()))])
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(texts, pa.list_(pa.string()))], schema=schema)
    parts = list(keywords._lister()([batch]))
    got = {(r["run"], e) for p in parts for r in p.to_pylist() for e in r["events"]}
    assert got == {(t[k : k + 3], i) for i, (t,) in enumerate(texts) for k in range(len(t) - 2)}


def test_workers_need_no_package():
    """What goes to the tasks runs in a process that can't import this package."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    code = "import pickle, sys; f = pickle.loads(sys.stdin.buffer.read()); print(list(f([])), 'eventfold' in sys.modules)"
    out = subprocess.run([sys.executable, "-P", "-c", code], input=cloudpickle.dumps(keywords._lister()), capture_output=True, cwd="/", check=True)
    assert out.stdout.split() == [b"[]", b"False"]


def test_looked_up_together_as_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(keywords, "MOST_WORDS", 5)
    rng = random.Random(8)
    ids = [1, 2, 3, 65_535, 65_536, 65_537, 2**33]
    members = [(i, *(rng.choice([None, text(rng)]) for _ in range(5))) for i in ids for _ in range(3)]
    events = [(i, f"Name {text(rng)}", text(rng), None, text(rng), rng.choice([None, [text(rng)], [text(rng), "DEPT"]])) for i in ids]
    m = spark.createDataFrame(members, "event_id long, " + ", ".join(f"{c} string" for c in library.SEARCHED))
    e = spark.createDataFrame(events, "event_id long, " + ", ".join(f"{c} string" for c in library.NAMED) + ", processing_departments array<string>")
    words = ["a", "ab", "abc", "门口积", "𝒳", "zzz", "dept", "x y", "name", "a", "b c", "é", "门口", "\x00", "x y" + "x y" * 40]
    want = {(w, r[0]) for w in words for r in (*members, *((*e[:5], *(e[5] or ())) for e in events)) if any(w in (x or "").lower() for x in r[1:])}
    for some in (words, [w for w in words if len(w) > 2]):
        with Scratch(spark) as owner:
            index = owner.staged(keywords.build(m, e), "keywords")
            got = [tuple(r) for r in keywords.lookup(m, e, index, some, owner).collect()]
        assert len(got) == len(set(got)) and set(got) == {x for x in want if x[0] in some}
