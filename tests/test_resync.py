"""An upload that repeats records of the corpus: they aren't parsed again, and nothing else differs."""

import itertools
import random
from pathlib import Path

from eventfold.engine import Engine
from eventfold.operators import normalize, sync
from eventfold.schemas import RECORD


def record(number, title, completed, row):
    values = dict.fromkeys(RECORD.fieldNames()) | {"source_row": row, "work_order_id": number, "title": title, "appeal_text": "地址：江海区礼乐街道德昌电机门口。", "received_at": "2026-09-01", "completed_at": completed}
    return tuple((values | {"raw_fields": {"工单编号": number, "=x": completed}})[f] for f in RECORD.fieldNames())


def put(engine, rows):
    r = engine.sync_records(engine.spark.createDataFrame(rows, RECORD), file_name="f.csv")
    return r.inserted, r.updated, r.missing


def shown(engine):
    """Runs, state and versions, times as their rank and syncs by their number."""
    runs = engine.list_sync_runs().collect()
    names = {r["id"]: n for n, r in enumerate(runs)}
    times = {t: n for n, t in enumerate(sorted(r["created_at"] for r in runs))}
    plain = lambda row: None if row is None else {k: names.get(v, v) if k == "last_sync_id" else times[v] if k in ("created_at", "updated_at") and v else v for k, v in row.asDict(recursive=True).items()}
    rows = [plain(r) for r in engine.list_current_orders().collect()]
    versions = sorted(str((names[v["sync_id"]], v["record_key"], v["action"], plain(v["before"]), plain(v["after"]), times[v["created_at"]])) for v in engine.versions().collect())
    counted = [(r["nth"], r["n_versions"]) for r in engine.sync_history().orderBy("nth").collect()]
    return [(r["file_hash"], r["business_columns"]) for r in runs], rows, versions, counted


def test_equal_records_are_parsed_once(spark, tmp_path, monkeypatch):
    """Random uploads, keys that repeat and blank ones among them, give what parsing all of them gives."""
    rng = random.Random(7)
    uploads = [[record(rng.choice(["A", "B", "C", "D", "E", "F", "G", " "]), rng.choice(["甲", "乙"]), rng.choice([None, "2026-09-03"]), rng.choice([2, 3, 4]) * 10 + k % 2) for k in range(9)] for _ in range(4)]
    uploads = [list({r[0:2]: r for r in rows}.values()) for rows in uploads]  # ties of key and place are left open
    uploads.insert(2, uploads[1] + uploads[1][:2])
    seen, stamps, real, stamp = [], itertools.count(), normalize.normalize, normalize.stamp
    monkeypatch.setattr(normalize, "normalize", lambda records, **given: seen.append(records.count()) or real(records, **given))
    found, parsed = [], []
    for name, most, anew in (("reused", sync.BROADCAST_KEYS, False), ("joined", -1, False), ("anew", sync.BROADCAST_KEYS, True)):
        monkeypatch.setattr(sync, "BROADCAST_KEYS", most)
        monkeypatch.setattr(normalize, "stamp", lambda spark: f"{next(stamps)}" if anew else stamp(spark))
        engine = Engine(spark, f"file://{tmp_path}/{name}")
        seen.clear()
        found.append(([put(engine, rows) for rows in uploads], shown(engine)))
        parsed.append(list(seen))
    assert found[0] == found[1] == found[2]
    assert parsed[2] == [len(rows) for rows in uploads] and parsed[0] == parsed[1]
    assert sum(parsed[0]) < sum(parsed[2]) and parsed[0][2] < len(uploads[2])


def test_a_sync_writes_a_row_once(spark, tmp_path):
    """Of a first upload the corpus is all that is written of its rows, and is the log of versions."""
    engine = Engine(spark, f"file://{tmp_path}/store")
    put(engine, [record(str(k), "甲", None, k) for k in range(5)])
    folders = {p.parent.parent.name for p in Path(tmp_path).glob("store/*/*/*.parquet")}
    assert folders == {"work_orders", "sync_runs"}
    assert {(v["action"], v["before"], v["after"]["title_raw"], v["after"]["missing_in_latest_upload"]) for v in engine.versions().collect()} == {("inserted", None, "甲", False)}
