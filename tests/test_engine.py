"""Sync, comparison, review and export scenarios over small record sets."""

from datetime import date

import pytest

from eventfold.engine import Engine
from eventfold.jobs import ActiveJobConflictError
from eventfold.operators.library import EventFilters
from eventfold.operators.windows import Windows, WindowOverlapError, from_text, parse_flag
from eventfold.schemas import RECORD
from eventfold.sources.xlsx import Workbook


def record(number, received="2026-09-01", completed=None, title="德昌电机门口积水", location="江海区礼乐街道德昌电机门口", category="道路积水", row=2, **more):
    values = dict.fromkeys(RECORD.fieldNames()) | {"source_row": row, "work_order_id": number, "title": title, "category": category, "appeal_text": f"地址：{location}。事项：{category}。", "received_at": received, "completed_at": completed, "location": location}
    values["raw_fields"] = {"工单编号": number, "受理时间": received, "办结时间": completed} | more.pop("raw", {})
    return tuple((values | more)[f] for f in RECORD.fieldNames())


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/store")


def put(engine, *rows):
    r = engine.sync_records(engine.spark.createDataFrame(list(rows), RECORD), file_name="f.csv")
    return r.inserted, r.updated, r.missing


def test_sync_inserts_updates_and_flags(engine):
    assert put(engine, record("A"), record("B", "2026-09-02")) == (2, 0, 0)
    assert put(engine, record("A", completed="2026-09-03 12:00")) == (0, 1, 1)
    state = {r["record_key"]: r for r in engine.list_current_orders().collect()}
    assert (state["wo:A"]["missing_in_latest_upload"], state["wo:B"]["missing_in_latest_upload"]) == (False, True)
    assert state["wo:A"]["event_key"] == "ordinary|江海区|礼乐街道|德昌电机门口|道路积水"
    runs = engine.list_sync_runs().collect()
    assert engine.version_count(runs[0]["id"]) == 2 and runs[0]["business_columns"][:1]
    # B comes back, which is an update; the same file again changes nothing.
    assert put(engine, record("A", completed="2026-09-03 12:00"), record("B", "2026-09-02")) == (0, 1, 0)
    assert put(engine, record("A", completed="2026-09-03 12:00"), record("B", "2026-09-02")) == (0, 0, 0)
    with pytest.raises(ValueError):
        put(engine)
    assert engine.list_sync_runs(limit=1).first()["status"] == "failed" and engine.count_current_orders() == 2


def test_last_row_of_a_key_wins_and_blank_ids_are_fingerprinted(engine):
    put(engine, record("A", completed="2026-09-01", row=2), record("A", completed="2026-09-03", row=3), record("  ", row=4))
    rows = engine.list_current_orders().collect()
    assert len(rows) == 2 and rows[0]["record_key"].startswith("fp:")
    assert str(rows[1]["completed_at"]) == "2026-09-02 16:00:00"
    assert put(engine, record("A", completed="2026-09-03", row=3), record(" ", "2026-10-10", row=4))[0] == 0


def test_few_changes_and_many_give_the_same(engine, monkeypatch):
    import random

    from eventfold.operators import sync

    rng = random.Random(3)
    uploads = []
    for _ in range(3):
        keys = rng.sample(range(12), 8)
        uploads.append([record(f"K{k}", completed=rng.choice([None, "2026-09-03"]), title=rng.choice(["甲", "乙"]), raw={"=x": rng.choice(["1", None])}) for k in keys])
    states = []
    for most in (sync.BROADCAST_KEYS, -1):
        monkeypatch.setattr(sync, "BROADCAST_KEYS", most)
        fresh = Engine(engine.spark, f"{engine.store.root}-{most}")
        counts = [put(fresh, *rows) for rows in uploads]
        names = {r["id"]: n for n, r in enumerate(fresh.list_sync_runs().collect())}
        rows = fresh.list_current_orders().collect()
        versions = sorted((names[v["sync_id"]], v["record_key"], v["action"], str(v["after"]["title_raw"])) for v in fresh.versions().collect())
        states.append((counts, [(r["record_key"], r["title_raw"], r["completed_at"], r["raw_json"], r["missing_in_latest_upload"], names[r["last_sync_id"]]) for r in rows], versions))
    assert states[0] == states[1] and len(states[0][1]) > 8


def test_a_sync_of_few_changes_shuffles_no_row(spark):
    from pyspark.sql import functions as F

    from eventfold.operators import sync

    current = spark.range(5000).select(F.concat(F.lit("wo:"), "id").alias("record_key"), F.lit("x").alias("title"), F.lit(False).alias("missing_in_latest_upload"), F.lit("s1").alias("last_sync_id"), F.lit(1).alias("created_at"), F.lit(1).alias("updated_at"))
    upload = current.select("record_key", F.when(F.col("record_key") == "wo:7", "y").otherwise(F.col("title")).alias("title"))
    changed = sync.actions(upload, current)
    assert [tuple(r) for r in changed.collect()] == [("wo:7", "updated")]
    plan = sync.carried(current, changed, sync_id="s2")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "left_anti" in plan.lower().replace("leftanti", "left_anti")
    assert [r["last_sync_id"] for r in sync.carried(current, changed, sync_id="s2").select("last_sync_id").distinct().collect()] == ["s2"]


def test_form_fields():
    assert from_text(date(2026, 9, 5), "received_at").target_to == date(2026, 9, 5)
    assert from_text(date(2026, 9, 5), "received_at", "2026-09-01").target_to == date(2026, 9, 1)
    with pytest.raises(ValueError):
        from_text(None, "received_at")
    assert [parse_flag(x) for x in (" ON", "1", "0", None)] == [True, True, False, False]


def test_window_rules():
    with pytest.raises(WindowOverlapError):
        Windows("completed_at", date(2026, 9, 1), date(2026, 9, 30), date(2026, 9, 20), date(2026, 10, 10))
    for bad in (("x", 1, 2), ("received_at", 2, 1), ("received_at", 1, 2, 4, 3), ("received_at", 1, 2, 4)):
        with pytest.raises(ValueError):
            Windows(bad[0], *(date(2026, 9, d) for d in bad[1:]))


def test_comparison_review_and_export(engine, tmp_path):
    org = {"location": "江海区礼乐街道", "category": "其他"}
    put(
        engine,
        record("A", "2026-09-01", "2026-01-02"),
        record("B", "2026-09-02", "2026-09-05"),
        record("C", "2026-09-03", "2026-12-31", title="某食品厂食品安全问题", **org),
        record("D", "2026-09-04", None, title="反映某食品厂食品安全问题", row=5, **org),
        record("E", "2026-09-05", "2026-09-06", title="某食品厂拖欠工资", row=6, raw={"=x": "=1+1"}, **org),
    )
    out = engine.compare(time_field="completed_at", target_from=date(2026, 9, 1), target_to=date(2026, 9, 30))
    assert (out.target_count, out.reference_count, out.event_count, out.missing_time_count) == (3, 2, 3, 1)
    run = engine.get_comparison(out.comparison_id)
    assert run["reference_mode"] == "complement" and str(run["target_to"]) == "2026-09-30 16:00:00"
    manual = engine.compare(time_field="completed_at", target_from=date(2026, 9, 1), target_to=date(2026, 9, 30), reference_from=date(2026, 1, 1), reference_to=date(2026, 1, 31))
    assert (manual.target_count, manual.reference_count) == (3, 1)
    page, total = engine.list_event_summaries(out.comparison_id, sort="member_count_desc")
    sizes = [(r["member_count"], r["target_count"]) for r in page.collect()]
    assert total == 3 and sorted(sizes) == [(1, 1), (2, 1), (2, 1)] and engine.count_singleton_events(out.comparison_id) == 1
    assert engine.event_filter_options(out.comparison_id)["regions"] == ["江海区"]
    assert engine.list_event_summaries(out.comparison_id, filters=EventFilters(keyword="拖欠", region="x", search_all=True))[1] == 1
    assert engine.list_event_summaries(out.comparison_id, filters=EventFilters(missing_completed=True))[1] == 0
    event = page.where("event_name like '%积水%'").first()["event_id"]
    engine.update_event_name(event, " 新名称 ")
    assert engine.comparison_of(event) == out.comparison_id
    assert engine.get_event(out.comparison_id, event)["event_name"] == "新名称"
    new = engine.exclude_event_member(out.comparison_id, event, "wo:A")
    found, rows, n = engine.list_event_records(out.comparison_id, new)
    assert (found["event_name"], n, rows.first()["record_key"]) == ("单例事件", 1, "wo:A")
    assert engine.exclude_event_member(out.comparison_id, event, "wo:B", target_name="单例事件") == new
    assert engine.get_event(out.comparison_id, event)["status"] == "archived"
    with pytest.raises(KeyError):
        engine.update_event_name(999, "x")
    path = engine.export_workbook(out.comparison_id, str(tmp_path / "out.xlsx"))
    book = Workbook(open(path, "rb").read())
    assert list(book.sheets) == ["重复项", "孤立工单"]
    lone = list(book.rows("孤立工单"))
    assert lone[0][1][0] == "数据侧" and lone[1][1][0] == "待比对" and "'=1+1" in lone[1][1].values()
    assert len(list(book.rows("重复项"))) == 5
    assert engine.count_comparisons() == 2 and engine.latest_local_date("received_at") == date(2026, 9, 5)


def test_one_active_job(engine):
    job = engine.create_job("compare", {"target_from": "2026-09-01", "target_to": "2026-09-02"})
    with pytest.raises(ActiveJobConflictError):
        engine.create_job("sync", {})
    done = engine.work()
    assert done["id"] == job and done["status"] == "failed" and "synced" in done["error_message"]
    assert engine.work() is None and engine.list_jobs().count() == 1


def test_of_two_writers_one_wins(engine):
    store, rows = engine.store, engine.spark.createDataFrame([(1,)], "n int")
    base = store.version()
    assert store.commit(append={"t": store.stage("t", rows)}, base=base) == base + 1
    with pytest.raises(FileExistsError):
        store.commit(append={"t": store.stage("t", rows)}, base=base)
    assert not store._put(base + 1, "{}") and len(store.manifest()["t"]) == 1
    # What depends on nothing is tried again on the newest version.
    assert store.commit(append={"t": store.stage("t", rows)}) == base + 2 and len(store.manifest()["t"]) == 2


def test_a_job_is_claimed_once(engine, monkeypatch):
    job, jobs = engine.create_job("sync", {}), engine.jobs
    real, rivals = jobs._put, []

    def late(rows, base):  # another writer claims between this one's reading and writing
        if not rivals:
            rivals.append(None)
            rivals[0] = jobs.claim()
        real(rows, base)

    monkeypatch.setattr(jobs, "_put", late)
    assert jobs.claim() is None and rivals[0]["id"] == job and engine.get_job(job)["status"] == "running"


def test_summaries_are_kept_until_something_changes(engine):
    put(engine, record("A"), record("B", "2026-09-02"))
    out = engine.compare(target_from=date(2026, 9, 1), target_to=date(2026, 9, 1))
    first = engine._settled(out.comparison_id)
    event = engine.event_summaries(out.comparison_id).first()["event_id"]
    assert engine._settled(out.comparison_id) is first
    engine.update_event_name(event, "x")
    assert engine.event_summaries(out.comparison_id).first()["event_name"] == "x"
    # Event ids are unique over comparisons.
    again = engine.compare(target_from=date(2026, 9, 1), target_to=date(2026, 9, 1))
    assert engine.event_summaries(again.comparison_id).first()["event_id"] == event + 1


def test_numbers_follow_the_order(spark):
    from pyspark.sql import functions as F

    from eventfold.operators.events import number

    rows = spark.range(0, 5000, 1, 7).select(((F.col("id") * 7919) % 5000).alias("v"))
    got = number(rows, [F.lit(0), F.concat(F.lit("wo:aaaaaaaaaaaaaa"), F.lpad(F.col("v").cast("string"), 6, "0"))], "n").collect()
    assert all(r["n"] == r["v"] + 1 for r in got) and len(got) == 5000
