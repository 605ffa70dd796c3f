"""What is kept of a comparison: overrides worked in by increment, keywords, and workbooks."""

import random
import zipfile
import zlib
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from eventfold.engine import Engine
from eventfold.operators import keywords, library
from eventfold.operators.library import EventFilters
from eventfold.plans import roundtrips
from eventfold.sources import xlsx_sink
from eventfold.sources.store import Scratch, scratch_root
from eventfold.sources.xlsx import Workbook


@pytest.fixture(scope="module")
def engine(spark, sf_dir, tmp_path_factory):
    found = Engine(spark, f"file://{tmp_path_factory.mktemp('settled')}/store")
    found.sync_records(roundtrips.records(spark, sf_dir).where("work_order_id % 4 = 0"), file_name="f.csv")
    found.run = found.compare(target_from=date(1997, 1, 1), target_to=date(1998, 12, 31)).comparison_id
    return found


def shown(frame):
    return sorted(str(r) for r in frame.select(sorted(frame.columns)).collect())


def test_overrides_by_increment(engine):
    """Random moves, exclusions and names in three batches give what a full rebuild gives, and only
    the members of touched events are read for it."""
    rng, run = random.Random(4), engine.run
    place = {r["record_key"]: r["event_id"] for r in engine.members(run).select("record_key", "event_id").collect()}
    before = engine._settled(run)
    for batch in range(3):
        rows = []
        for _ in range(17):
            key = rng.choice(list(place)[:60])
            to = rng.choice(list(place.values())[:40])
            rows.append({"kind": "move", "event_id": place[key], "record_key": key, "to_event": to})
            place[key] = to
            if rng.random() < 0.3:
                rows.append({"kind": "rename", "event_id": to, "name": f"name {batch} {rng.random()}"})
        engine._override(run, rows, engine.store.version())
        kept = engine._settled(run)
        assert kept is before and 0 < len(kept.touched) < 150
        anew = Engine(engine.spark, engine.store.root)
        for frames in ((kept.members, anew._settled(run).members), (engine.event_summaries(run), anew.event_summaries(run))):
            assert shown(frames[0]) == shown(frames[1])
        assert {r["record_key"]: r["event_id"] for r in kept.members.collect()} == place
        assert shown(kept.find("name 1").select("event_id")) == shown(anew._settled(run).find("name 1").select("event_id"))
        anew.release()
    engine.MOST_TOUCHED = 5
    engine._override(run, [{"kind": "rename", "event_id": e, "name": "many"} for e in sorted(set(place.values()))[:6]], engine.store.version())
    assert engine._settled(run) is not before and engine.event_summaries(run).where("event_name = 'many'").count() > 0
    del engine.MOST_TOUCHED


def test_pages_and_filters_of_kept_summaries(engine):
    members = engine._settled(engine.run).members
    day = date(1995, 6, 1)
    for f in (EventFilters(), EventFilters(keyword="1-urg"), EventFilters(keyword="o", hide_singletons=True), EventFilters(completed_from=day), EventFilters(completed_to=day, street="礼乐街道"), EventFilters(missing_completed=True), EventFilters(has_target_records=True, region="江海区", processing_department="BUILDING"), EventFilters(keyword="MACHINERY", region="x", search_all=True)):
        assert shown(engine.event_summaries(engine.run, f)) == shown(library.summaries(members, f)), f


def read_by(page):
    """Rows of the page, and how many the scan gave for it."""
    rows = page.collect()
    plan = page._jdf.queryExecution().executedPlan()
    found, open_ = [], [plan]
    while open_:
        node = open_.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            open_.append(node.executedPlan())
        elif node.getClass().getSimpleName().endswith("QueryStageExec"):
            open_.append(node.plan())
        elif node.getClass().getSimpleName() == "FileSourceScanExec":
            found.append(node.metrics().apply("numOutputRows").value())
        else:
            open_ += [node.children().apply(k) for k in range(node.children().size())]
    return rows, sum(found)


@pytest.fixture
def parted(spark):
    """Small tables keep their ranges, as large ones do."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def test_pages_read_a_range(engine, parted):
    engine.release()
    kept = engine._settled(engine.run)
    for sort in library.SORTS:
        want = kept.summaries.drop("completed_days").orderBy(*library.ordering(sort)).collect()
        for offset in (0, 7, 150, len(want) - 5, len(want) + 5):
            page, total = engine.list_event_summaries(engine.run, sort=sort, limit=20, offset=offset)
            rows, seen = read_by(page)
            assert rows == want[offset : offset + 20] and total == len(want)
            assert seen <= total * 0.6  # one of four ranges, or two where a page meets the next
    some = kept.members.where("event_id = 11")
    rows, seen = read_by(some)
    assert rows and seen <= kept.members.count() * 0.6


WORDS = ["a", "ab", "abc", "bca", "ABC", "abcabc", "门口", "门口积", "é𝒳门", "𝒳", "zzz", "dept", "x y", " y", "name", "aab", "cab", "b", "é", "abcd"]


def test_keyword_candidates(spark):
    rng = random.Random(5)
    text = lambda: "".join(rng.choice(["a", "b", "C", "é", "𝒳", "门口积", " ", "x y"]) for _ in range(rng.randint(0, 12)))
    ids = [1, 2, 3, 65_535, 65_536, 65_537, 2**33]
    members = [(i, *(rng.choice([None, text()]) for _ in range(5))) for i in ids for _ in range(3)]
    events = [(i, f"Name {text()}", text(), None, text(), [text() for _ in range(rng.randint(0, 2))]) for i in ids]
    m = spark.createDataFrame(members, "event_id long, " + ", ".join(f"{c} string" for c in library.SEARCHED))
    e = spark.createDataFrame(events, "event_id long, " + ", ".join(f"{c} string" for c in library.NAMED) + ", processing_departments array<string>")
    with Scratch(spark) as owner:
        index = owner.staged(keywords.build(m, e), "keywords")
        for w in WORDS:
            w = w.lower()
            want = {r[0] for r in members if any(w in (x or "").lower() for x in r[1:])} | {r[0] for r in events if any(w in (x or "").lower() for x in (*r[1:5], *r[5]))}
            assert {r["event_id"] for r in keywords.hits(m, e, index, w).collect()} == want, w
            if len(w) >= 3:
                assert want <= {r["event_id"] for r in keywords.candidates(index, w).collect()}


def test_joined_check_sums():
    rng = random.Random(6)
    for _ in range(30):
        a, b = rng.randbytes(rng.randint(0, 300)), rng.randbytes(rng.randint(0, 70_000))
        assert xlsx_sink.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_a_workbook_of_many_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(xlsx_sink, "PIECE", 2000)
    rows = spark.range(0, 3000, 1, 7).select(((F.col("id") * 7919) % 3000).alias("k"), (F.col("id") % 2).alias("band"))
    rows = rows.select("k", "band", F.when(F.col("k") % 5 != 0, F.concat(F.lit("<行>\n"), "k")).alias("文"), F.col("k").alias("`n`"[1:2]))
    for path in (str(tmp_path / "a.xlsx"), f"file://{tmp_path}/b/c.xlsx"):
        xlsx_sink.write(path, {"一": (["文", "n"], rows), "空": (["文"], rows.limit(0))}, ["k"], "band")
        data = Path(path.removeprefix("file://")).read_bytes()
        assert zipfile.ZipFile(Path(path.removeprefix("file://"))).testzip() is None
        book = Workbook(data)
        got = list(book.rows("一"))
        assert [n for n, _ in got] == list(range(1, 3002)) and [r[1] for _, r in got[1:]] == [str(k) for k in range(3000)]
        assert got[1][1][0] is None and got[2][1][0] == "<行>\n1" and len(list(book.rows("空"))) == 1
    monkeypatch.setattr(xlsx_sink, "MOST_ROWS", 2999)
    with pytest.raises(ValueError, match="3000 rows"):
        xlsx_sink.write(str(tmp_path / "d.xlsx"), {"一": (["文"], rows)}, ["k"], "band")


def test_nothing_is_left_behind(engine):
    root = Path(scratch_root(engine.spark).removeprefix("file://"))
    engine.release()
    before = set(root.iterdir()) if root.exists() else set()
    engine.event_summaries(engine.run, EventFilters(keyword="urgent")).collect()
    engine.update_event_name(1, "y", comparison_id=engine.run)
    engine.event_summaries(engine.run).collect()
    assert set(root.iterdir()) - before
    engine.release()
    assert set(root.iterdir()) == before
