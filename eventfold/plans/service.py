"""Queries of the engine's listings over a store that is filled from the bundled tables, with their SQL.

The store of one session and scale is made once: two uploads of orders as complaint records (the
first without keys that end with 7; the second without those that leave 1 modulo 100, and with other
titles for those that 50 divides). A comparison of the corpus that results is made for the queries that
read one, and a second one for those that read both.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import rules
from ..operators import library, review
from ..sources import files
from ..sources.store import scratch, staged
from . import adapter as a
from . import roundtrips

_MADE: dict[tuple[str, str], Engine] = {}


def _filled(spark: SparkSession, sf_dir: str) -> Engine:
    engine = Engine(spark, scratch(spark, "service"))
    rows = roundtrips.records(spark, sf_dir)
    number = F.col("work_order_id").cast("long")
    engine.sync_records(rows.where("work_order_id not like '%7'"), file_name="first.csv", file_hash="1")
    title = F.when(number % 50 == 0, F.concat("title", F.lit("，已补充"))).otherwise(F.col("title"))
    engine.sync_records(rows.where(number % 100 != 1).withColumn("title", title), file_name="second.csv", file_hash="2")
    return engine


def _with_first(engine: Engine) -> Engine:
    """The engine with its first comparison."""
    if not engine.count_comparisons():
        engine.first = engine.compare(target_from=a.TARGET.target_from, target_to=a.TARGET.target_to).comparison_id
    return engine


def service(spark: SparkSession, sf_dir: str) -> Engine:
    """The filled engine of this application; nothing changes it but `moved` below, which has its own."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _MADE or not _MADE[key].store.version():
        _MADE[key] = _filled(spark, sf_dir)
    return _MADE[key]


def compared(spark: SparkSession, sf_dir: str) -> Engine:
    """The same engine with its first comparison, which is made when first asked for."""
    return _with_first(service(spark, sf_dir))


def compared_twice(spark: SparkSession, sf_dir: str) -> Engine:
    """The same engine with its second comparison, which is made when first asked for."""
    engine = compared(spark, sf_dir)
    if engine.count_comparisons() < 2:
        engine.compare(time_field="completed_at", target_from=date(1997, 1, 1), target_to=date(1997, 12, 31))
    return engine


def sync_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, the latest first, with the number of versions that each has left."""
    return service(spark, sf_dir).sync_history().select("nth", "file_name", "file_hash", "status", "total_rows", "inserted_rows", "updated_rows", "missing_rows", "n_versions")


def version_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second upload changed, before and after."""
    engine = service(spark, sf_dir)
    last = engine.sync_history().where("nth = 1").select(F.col("id").alias("sync_id"))
    rows = engine.versions().join(F.broadcast(last), "sync_id", "left_semi")
    return rows.select("record_key", "action", F.col("before.title_raw").alias("title_before"), F.col("after.title_raw").alias("title_after"), F.col("after.missing_in_latest_upload").alias("gone"))


def corpus_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the corpus in the order of its keys."""
    rows = service(spark, sf_dir).list_current_orders().select("record_key", "title_raw", "missing_in_latest_upload")
    return library.page(rows, [F.asc("record_key")], 50, 200)


def comparison_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of a comparison, with fields out of their snapshots."""
    engine = compared(spark, sf_dir)
    found = engine.list_comparison_members(engine.first)
    return found.select("record_key", "side", "event_key", "work_order_id", F.col("snapshot.title_raw").alias("title"), F.col("snapshot.raw_json")["处理部门"].alias("department"))


def member_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of twenty events with their snapshots' fields."""
    engine = compared(spark, sf_dir)
    found = engine.event_member_snapshots(engine.first, list(range(11, 31)))
    return found.select("event_id", "event_name", "record_key", "side", "title_raw", "category", F.col("received_at").cast("timestamp_ntz").alias("received_at"))


def event_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events each comparison has, and between which ids."""
    engine = compared_twice(spark, sf_dir)
    named = F.when(F.col("comparison_id") == engine.first, "first").otherwise("second")
    return engine.event_owners().groupBy(named.alias("comparison")).agg(F.count("*").alias("n"), F.min("event_id").alias("least"), F.max("event_id").alias("greatest"))


def event_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by their ids, one of which there is not."""
    engine = compared(spark, sf_dir)
    return engine.find_events(engine.first, [1, 7, 100, 10**12]).select("event_id", "event_name", "status")


def deep_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages far down in each order, read as ranges of places."""
    engine, out = compared(spark, sf_dir), None
    for sort in library.SORTS:
        for offset in (0, 200, 300):
            page = engine.list_event_summaries(engine.first, sort=sort, limit=20, offset=offset)[0]
            page = page.select(F.lit(sort).alias("sort"), F.lit(offset).alias("begins"), "event_id", "event_name", "member_count")
            out = page if out is None else out.union(page)
    return out


def comparison_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparisons, the latest first, with the headers of the upload that they stand on."""
    return compared_twice(spark, sf_dir).comparison_headers().select("nth", "time_field", "reference_mode", "target_count", "reference_count", "event_count", F.array_join("headers", ",").alias("headers"))


def default_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export rows under the headers that hold where no upload recorded any."""
    rows = a.event_members(spark, sf_dir).withColumns({"raw_json": F.create_map().cast("map<string,string>"), "location": F.col("street")})
    rows = staged(rows, "members")
    out = review.sheets(staged(review.export_rows(rows, library.summaries(rows, library.EventFilters(hide_singletons=True)))), list(rules.CANONICAL_HEADERS))
    names = ("number", "received", "completed", "title", "category", "department", "handled_by", "place", "appeal")
    return out.select("record_key", "sheet", *(F.col(h).alias(n) for h, n in zip(rules.CANONICAL_HEADERS, names, strict=True)))


def archived_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events left without members are archived, and left out of exports; the others stay."""
    engine = _with_first(_filled(spark, sf_dir))
    run = engine.first
    lone = engine.event_summaries(run).where("member_count = 1 and event_id between 2 and 200").select("event_id")
    keys = engine._settled(run).members.join(F.broadcast(lone), "event_id", "left_semi").select("event_id", "record_key").orderBy("event_id").collect()  # 199 at most
    engine._override(run, [{"kind": "move", "event_id": r["event_id"], "record_key": r["record_key"], "to_event": 1} for r in keys], engine.store.version())
    exported = engine.export_rows(run).groupBy("event_id").agg(F.count("*").alias("exported"))
    return engine.list_comparison_events(run).where("event_id <= 200").join(exported, "event_id", "left").select("event_id", "status", F.coalesce("exported", F.lit(0)).alias("exported"))


def row_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether tables stay within limits, alone and together; no more rows are counted than it takes."""
    tables = {t: a.table(spark, sf_dir, t) for t in ("orders", "customer", "events")}
    out = None
    for most in (1_000, 12_000, 200_000):
        for name, frames in (*((t, [f]) for t, f in tables.items()), ("together", list(tables.values()))):
            row = files.within_limit(frames, most).select(F.lit(name).alias("given"), F.lit(most).cast("long").alias("most"), "within")
            out = row if out is None else out.union(row)
    return out


_TITLE = "c_name || CASE WHEN o_orderkey % 50 = 0 THEN '积水的问题，已补充' ELSE '积水的问题' END"
_LIVE = roundtrips.events_sql("WHERE o_orderkey % 100 <> 1")
_NUMBERED = "n AS (SELECT row_number() OVER (ORDER BY s, CASE WHEN s = 0 THEN r0 ELSE r1 END) event_id, * FROM g)"
_COUNTS = "SELECT count(*) FILTER (o_orderkey % 10 <> 7) old, count(*) FILTER (o_orderkey % 100 <> 1) now, count(*) FILTER (o_orderkey % 10 = 7) added, count(*) FILTER (o_orderkey % 50 = 0) changed, count(*) FILTER (o_orderkey % 100 = 1) gone FROM orders"
_DAYS = {"received_at": f"{a.DAY.format('CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) - INTERVAL 8 HOUR')}", "completed_at": "CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS DATE) END"}

#: Each query with its SQL.
ALL = {
    sync_versions: f"WITH c AS ({_COUNTS}) SELECT 1 nth, 'second.csv' file_name, '2' file_hash, 'completed' status, now total_rows, added inserted_rows, changed updated_rows, gone missing_rows, added + changed + gone n_versions FROM c UNION ALL SELECT 2, 'first.csv', '1', 'completed', old, old, 0, 0, old FROM c",
    version_rows: f"SELECT 'wo:' || o_orderkey record_key, CASE WHEN o_orderkey % 100 = 1 THEN 'missing' WHEN o_orderkey % 50 = 0 THEN 'updated' ELSE 'inserted' END AS action, CASE WHEN o_orderkey % 10 <> 7 THEN '[热线]反映' || c_name || '积水的问题' END title_before, CASE WHEN o_orderkey % 100 <> 1 THEN '[热线]反映' || {_TITLE} END title_after, o_orderkey % 100 = 1 gone FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 100 = 1 OR o_orderkey % 50 = 0 OR o_orderkey % 10 = 7",
    corpus_page: f"SELECT 'wo:' || o_orderkey record_key, '[热线]反映' || {_TITLE} title_raw, o_orderkey % 100 = 1 missing_in_latest_upload FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY record_key LIMIT 50 OFFSET 200",
    comparison_members: f"{_LIVE} SELECT record_key, CASE side WHEN 0 THEN 'target' ELSE 'reference' END side, event_key, substr(record_key, 4) work_order_id, '[热线]反映' || {_TITLE} title, c_mktsegment department FROM m JOIN orders ON o_orderkey = CAST(substr(record_key, 4) AS BIGINT) JOIN customer ON o_custkey = c_custkey",
    member_snapshots: f"{_LIVE}, {_NUMBERED} SELECT event_id, m.event_name, record_key, CASE side WHEN 0 THEN 'target' ELSE 'reference' END side, '[热线]反映' || {_TITLE} title_raw, o_orderpriority category, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) - INTERVAL 8 HOUR received_at FROM m JOIN n USING (event_key) JOIN orders ON o_orderkey = CAST(substr(record_key, 4) AS BIGINT) JOIN customer ON o_custkey = c_custkey WHERE event_id BETWEEN 11 AND 30",
    event_comparisons: f"{_LIVE} SELECT 'first' comparison, count(*) n, 1 least, count(*) greatest FROM g UNION ALL SELECT 'second', count(*), count(*) + 1, 2 * count(*) FROM g",
    event_lookups: f"{_LIVE}, {_NUMBERED} SELECT event_id, event_name, 'active' status FROM n WHERE event_id IN (1, 7, 100)",
    deep_pages: f"{_LIVE}, {_NUMBERED}, p AS (SELECT 'updated_desc' sort, event_id, event_name, member_count, row_number() OVER (ORDER BY event_id DESC) place FROM n UNION ALL SELECT 'member_count_desc', event_id, event_name, member_count, row_number() OVER (ORDER BY member_count DESC, event_id) FROM n UNION ALL SELECT 'member_count_asc', event_id, event_name, member_count, row_number() OVER (ORDER BY member_count, event_id) FROM n) SELECT sort, begins, event_id, event_name, member_count FROM p, (SELECT unnest([0, 200, 300]) begins) WHERE place > begins AND place <= begins + 20",
    comparison_headers: f"{_LIVE}, d AS (SELECT count(*) FILTER (t) target, count(*) FILTER (NOT t) other FROM (SELECT coalesce({_DAYS['completed_at']} BETWEEN '1997-01-01' AND '1997-12-31', true) t FROM orders WHERE o_orderkey % 100 <> 1)) SELECT 2 nth, 'received_at' time_field, 'complement' reference_mode, (SELECT count(*) FROM m WHERE side = 0) target_count, (SELECT count(*) FROM m WHERE side = 1) reference_count, (SELECT count(*) FROM g) event_count, '事项分类,所属部门,事发地点,办结时间' headers UNION ALL SELECT 1, 'completed_at', 'complement', target, other, (SELECT count(*) FROM g), '事项分类,所属部门,事发地点,办结时间' FROM d",
    default_columns: f"WITH {a.GROUPED} SELECT record_key, '重复项' sheet, work_order_id AS number, CAST(received_at AS VARCHAR) received, CAST(completed_at AS VARCHAR) completed, title_raw title, category, department, processing_department handled_by, street place, appeal_text appeal FROM event_members WHERE event_id IN (SELECT event_id FROM grouped WHERE member_count > 1)",
    archived_events: f"{_LIVE}, {_NUMBERED} SELECT event_id, CASE WHEN event_id > 1 AND member_count = 1 THEN 'archived' ELSE 'active' END status, CASE WHEN event_id = 1 THEN member_count + (SELECT count(*) FROM n WHERE event_id BETWEEN 2 AND 200 AND member_count = 1) WHEN member_count = 1 THEN 0 ELSE member_count END exported FROM n WHERE event_id <= 200",
    row_limits: "WITH n AS (SELECT 'orders' given, (SELECT count(*) FROM orders) n UNION ALL SELECT 'customer', (SELECT count(*) FROM customer) UNION ALL SELECT 'events', (SELECT count(*) FROM events)), w AS (SELECT * FROM n UNION ALL SELECT 'together', sum(n) FROM n) SELECT given, most, n <= most AS within FROM w, (SELECT unnest([1000, 12000, 200000]) most)",
}
