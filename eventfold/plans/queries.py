"""One query for each operator over the bundled tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, keys, text
from ..operators import events, library, normalize, review, sync, windows
from ..operators.library import EventFilters
from . import adapter as a
from ..sources.store import staged
from . import fields, roundtrips, service

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def shown(df: DataFrame) -> DataFrame:
    """Timestamps without zone and lists as text, as SQL returns them."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        c = c.cast("timestamp_ntz") if kind == "timestamp" else F.array_join(c, ",") if kind == "array<string>" else c
        out.append(c.alias("departments" if name == "processing_departments" else name))
    return df.select(out)


SUMMARY_COLUMNS = "event_id, event_name, region, street_name, issue_name, member_count, target_count, first_received_at, last_received_at, departments"


@query(f"WITH {a.SUMMARY} SELECT {SUMMARY_COLUMNS} FROM summary")
def event_summary(spark, sf_dir):
    return shown(a.summaries(spark, sf_dir))


@query(f"WITH {a.GROUPED} SELECT event_id, event_key, event_name, member_count, target_count FROM grouped")
def event_groups(spark, sf_dir):
    return a.grouped(spark, sf_dir)


@query(f"WITH {a.GROUPED} SELECT count(*) event_count, count(*) FILTER (member_count = 1) singleton_count FROM grouped")
def event_counts(spark, sf_dir):
    return events.event_counts(a.members(spark, sf_dir).groupBy("event_key").agg(F.count("*").alias("member_count")))


@query(f"WITH {a.sided()} SELECT record_key, side FROM sided")
def window_complement(spark, sf_dir):
    return windows.assign_sides(a.work_orders(spark, sf_dir), a.TARGET).select("record_key", "side")


@query(f"WITH {a.sided(a.MANUAL)} SELECT record_key, side FROM sided")
def window_manual(spark, sf_dir):
    return windows.assign_sides(a.work_orders(spark, sf_dir), a.MANUAL).select("record_key", "side")


_COMPLETED = windows.Windows("completed_at", date(1997, 2, 1), date(1998, 8, 31))


@query(f"WITH {a.sided(_COMPLETED)} SELECT count(*) FILTER (side = 'target') target_count, count(*) FILTER (side = 'reference') reference_count, count(*) FILTER (completed_at IS NULL) missing_time_count FROM sided")
def window_side_counts(spark, sf_dir):
    return windows.side_counts(windows.assign_sides(a.work_orders(spark, sf_dir), _COMPLETED), "completed_at")


@query(f"SELECT CAST({a.DAY.format('ts')} AS VARCHAR) AS day, count(*) n FROM events GROUP BY 1")
def local_date_bucket(spark, sf_dir):
    return a.table(spark, sf_dir, "events").groupBy(dates.local_date(F.col("ts").cast("timestamp")).cast("string").alias("day")).agg(F.count("*").alias("n"))


@query(f"SELECT CAST({a.DAY.format('max(o_orderdate)')} AS VARCHAR) AS latest FROM orders WHERE o_orderstatus <> 'P'")
def latest_local_date(spark, sf_dir):
    rows = a.table(spark, sf_dir, "orders").withColumn("received_at", F.col("o_orderdate").cast("timestamp"))
    return library.latest_local_date(rows, "received_at", live=F.col("o_orderstatus") != "P").select(F.col("latest").cast("string").alias("latest"))


@query("SELECT event_id, CAST(CAST(ts + INTERVAL 8 HOUR AS DATE) AS TIMESTAMP) - INTERVAL 8 HOUR AS day_start, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS shown FROM events")
def local_day_bounds(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    return a.table(spark, sf_dir, "events").select("event_id", dates.local_start(dates.local_date(ts)).cast("timestamp_ntz").alias("day_start"), dates.local_text(ts).alias("shown"))


@query(f"WITH {a.MEMBERS} SELECT record_key, event_key, named AS event_name FROM members")
def event_key_rule(spark, sf_dir):
    return a.members(spark, sf_dir).select("record_key", "event_key", F.col("named").alias("event_name"))


_FILTERS = {
    "region": (EventFilters(region=" ASIA "), "region = 'ASIA'"),
    "street": (EventFilters(street="NATION_7"), "street_name = 'NATION_7'"),
    "department": (EventFilters(processing_department="BUILDING"), "list_contains(string_split(departments, ','), 'BUILDING')"),
    "target": (EventFilters(has_target_records=True), "target_count > 0"),
    "singletons": (EventFilters(hide_singletons=True), "member_count > 1"),
    "missing_completed": (EventFilters(missing_completed=True), "event_id NOT IN (SELECT event_id FROM event_members WHERE completed_at IS NOT NULL)"),
    "completed": (EventFilters(completed_from=date(1997, 1, 10), completed_to=date(1997, 2, 20)), f"event_id IN (SELECT event_id FROM event_members WHERE {a.DAY.format('completed_at')} BETWEEN '1997-01-10' AND '1997-02-20')"),
    "combined": (EventFilters(region="EUROPE", has_target_records=True, hide_singletons=True, keyword="furn"), None),
}
_WORD = "event_id IN (SELECT event_id FROM event_members WHERE contains(lower(concat_ws('|', work_order_id, title_raw, appeal_text, department, processing_department)), '{w}')) OR contains(lower(concat_ws('|', event_name, issue_name, region, street_name, departments)), '{w}')"
_FILTERS["combined"] = (_FILTERS["combined"][0], f"region = 'EUROPE' AND target_count > 0 AND member_count > 1 AND ({_WORD.format(w='furn')})")
_FILTERS["search_all"] = (EventFilters(keyword=" uRgEnT ", region="nowhere", search_all=True), _WORD.format(w="urgent"))


def _filter(name: str, filters: EventFilters, where: str) -> None:
    def run(spark, sf_dir):
        return shown(a.summaries(spark, sf_dir, filters)).select("event_id", "event_name", "member_count", "target_count", "departments")

    run.__name__ = f"event_filter_{name}"
    query(f"WITH {a.SUMMARY} SELECT event_id, event_name, member_count, target_count, departments FROM summary WHERE {where}")(run)


for _name, (_f, _where) in _FILTERS.items():
    _filter(_name, _f, _where)


@query(f"WITH {a.SUMMARY} SELECT event_id, event_name FROM summary WHERE {_WORD.format(w='customer#000000012')}")
def keyword_search(spark, sf_dir):
    return a.summaries(spark, sf_dir, EventFilters(keyword="Customer#000000012")).select("event_id", "event_name")


@query(f"WITH {a.SUMMARY} SELECT string_agg(DISTINCT region, ',' ORDER BY region) regions, string_agg(DISTINCT street_name, ',' ORDER BY street_name) streets, (SELECT string_agg(DISTINCT d, ',' ORDER BY d) FROM (SELECT unnest(string_split(departments, ',')) d FROM summary WHERE region = 'ASIA')) departments FROM summary WHERE region = 'ASIA'")
def event_facets(spark, sf_dir):
    return shown(library.facets(a.summaries(spark, sf_dir), region="ASIA"))


@query(f"WITH {a.GROUPED} SELECT count(*) FILTER (member_count = 1) singleton_count FROM grouped")
def event_singletons(spark, sf_dir):
    return library.singletons(a.summaries(spark, sf_dir))


def _page(sort: str, order: str) -> None:
    def run(spark, sf_dir):
        found = a.summaries(spark, sf_dir)
        return library.page(found, library.ordering(sort), 20, 40).select("event_id", "event_name", "member_count")

    run.__name__ = f"event_page_{sort}"
    query(f"WITH {a.GROUPED} SELECT event_id, event_name, member_count FROM grouped ORDER BY {order} LIMIT 20 OFFSET 40")(run)


for _sort, _order in (("member_count_desc", "member_count DESC, event_id"), ("member_count_asc", "member_count, event_id"), ("updated_desc", "event_id DESC")):
    _page(_sort, _order)


@query(f"WITH {a.GROUPED} SELECT event_id, record_key, side, work_order_id, received_at FROM event_members WHERE event_id = 7 ORDER BY record_key LIMIT 20")
def event_records(spark, sf_dir):
    rows = a.event_members(spark, sf_dir).where("event_id = 7").select("event_id", "record_key", "side", "work_order_id", F.col("received_at").cast("timestamp_ntz").alias("received_at"))
    return library.page(rows, [F.asc("record_key")])


_PAIRS = "SELECT 'wo:' || CAST(x.o_orderkey AS VARCHAR) AS l, 'wo:' || CAST(y.o_orderkey AS VARCHAR) AS r FROM orders x JOIN orders y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey WHERE x.o_orderstatus = 'F' AND y.o_orderstatus = 'O'"


@query(f"WITH {a.MEMBERS}, pairs AS ({_PAIRS}), hit AS (SELECT DISTINCT unnest([p.l, p.r]) record_key FROM pairs p JOIN members x ON p.l = x.record_key JOIN members y ON p.r = y.record_key AND x.event_key = y.event_key) SELECT m.record_key, m.event_key || CASE WHEN h.record_key IS NULL THEN '' ELSE '|singleton|' || m.record_key END event_key FROM members m LEFT JOIN hit h USING (record_key)")
def conflict_split(spark, sf_dir):
    o = a.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    x, y = o.where("o_orderstatus = 'F'").alias("x"), o.where("o_orderstatus = 'O'").alias("y")
    pairs = x.join(y, (F.col("x.o_custkey") == F.col("y.o_custkey")) & (F.col("x.o_orderkey") < F.col("y.o_orderkey")))
    key = lambda c: F.concat(F.lit("wo:"), F.col(c).cast("string"))
    pairs = pairs.select(key("x.o_orderkey").alias("left"), key("y.o_orderkey").alias("right"))
    return events.split_conflicts(a.members(spark, sf_dir), pairs).select("record_key", "event_key")


def _overrides(rows: DataFrame) -> DataFrame:
    """Every 11th record moves to the event before its own, every 22nd then to event 1."""
    n = F.col("work_order_id").cast("long")
    first = rows.where((n % 11 == 0) & (F.col("event_id") > 1)).select(F.col("comparison_id"), n.alias("seq"), "event_id", "record_key", (F.col("event_id") - 1).alias("to_event"))
    then = first.where("seq % 22 = 0").select("comparison_id", (F.col("seq") + 10**12).alias("seq"), "event_id", "record_key", F.lit(1).cast("long").alias("to_event"))
    return first.union(then).withColumn("kind", F.lit("move"))


@query(f"WITH {a.GROUPED} SELECT record_key, CASE WHEN event_id > 1 AND CAST(work_order_id AS BIGINT) % 22 = 0 THEN 1 WHEN event_id > 1 AND CAST(work_order_id AS BIGINT) % 11 = 0 THEN event_id - 1 ELSE event_id END event_id FROM event_members")
def review_move(spark, sf_dir):
    rows = a.event_members(spark, sf_dir).withColumn("comparison_id", F.lit("c"))
    return review.moved(rows, _overrides(rows)).select("record_key", "event_id")


@query(f"WITH {a.GROUPED} SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'renamed twice ' || CAST(event_id AS VARCHAR) ELSE event_name END event_name FROM grouped")
def review_rename(spark, sf_dir):
    found = a.grouped(spark, sf_dir).withColumn("comparison_id", F.lit("c"))
    names = found.where("event_id % 10 = 0").select("comparison_id", "event_id", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("seq"))
    log = names.select("comparison_id", F.col("seq").cast("long").alias("seq"), F.lit("rename").alias("kind"), "event_id", F.concat(F.when(F.col("seq") == 2, "renamed twice ").otherwise("renamed "), F.col("event_id").cast("string")).alias("name"))
    return review.renamed(found, log).select("event_id", "event_name")


_EXPORT = ["工单编号", "诉求标题", "事项分类", "=note"]


@query(f"WITH {a.GROUPED}, chosen AS (SELECT event_id FROM grouped WHERE target_count > 0), rows AS (SELECT m.*, count(*) OVER (PARTITION BY event_id) n FROM event_members m WHERE event_id IN (SELECT event_id FROM chosen)), sheeted AS (SELECT *, CASE WHEN n > 1 THEN '重复项' ELSE '孤立工单' END sheet FROM rows) SELECT sheet, record_key, (dense_rank() OVER (PARTITION BY sheet ORDER BY event_id) - 1) % 2 AS band, CASE side WHEN 'target' THEN '待比对' ELSE '被比对' END AS 数据侧, event_name AS 事件名称, work_order_id AS id, title_raw AS title, CASE WHEN work_order_id LIKE '%3' THEN NULL ELSE category END AS category, '''=' || work_order_id AS note FROM sheeted")
def export_split(spark, sf_dir):
    rows = a.event_members(spark, sf_dir)
    blank = F.create_map(F.lit("事项分类"), F.lit(None).cast("string"), F.lit("=note"), F.concat(F.lit("="), "work_order_id"))
    plain = F.create_map(F.lit("=note"), F.concat(F.lit("="), "work_order_id"))
    rows = staged(rows.withColumn("raw_json", F.when(F.col("work_order_id").endswith("3"), blank).otherwise(plain)), "members")
    chosen = library.summaries(rows, EventFilters(has_target_records=True))
    out = review.sheets(staged(review.export_rows(rows, chosen)), _EXPORT)
    return out.select("sheet", "record_key", F.col("band").cast("long").alias("band"), "数据侧", "事件名称", F.col("工单编号").alias("id"), F.col("诉求标题").alias("title"), F.col("事项分类").alias("category"), F.col("=note").alias("note"))


def _snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Corpus and upload: without some keys each, with changed prices and rows missing before."""
    o = a.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("record_key"), "o_orderkey", F.col("o_totalprice").alias("price"), F.create_map(F.lit("p"), F.col("o_orderpriority")).alias("raw"))
    current = o.where("o_orderkey % 10 <> 0").withColumn("missing_in_latest_upload", F.col("o_orderkey") % 13 == 0)
    upload = o.where("o_orderkey % 10 <> 1").withColumn("price", F.when(F.col("o_orderkey") % 17 == 0, F.col("price") + 1).otherwise(F.col("price")))
    return upload, current


_DIFF = """WITH c AS (SELECT o_orderkey k, o_totalprice p, o_orderkey % 13 = 0 gone FROM orders WHERE o_orderkey % 10 <> 0),
u AS (SELECT o_orderkey k, o_totalprice + CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END p FROM orders WHERE o_orderkey % 10 <> 1),
d AS (SELECT CAST(coalesce(u.k, c.k) AS VARCHAR) record_key, CASE WHEN c.k IS NULL THEN 'inserted' WHEN u.k IS NULL THEN CASE WHEN gone THEN 'unchanged' ELSE 'missing' END WHEN u.p IS DISTINCT FROM c.p OR gone THEN 'updated' ELSE 'unchanged' END action FROM u FULL JOIN c ON u.k = c.k) """


@query(_DIFF + "SELECT * FROM d")
def snapshot_diff(spark, sf_dir):
    return sync.diff(*_snapshots(spark, sf_dir)).select("record_key", "action")


@query(_DIFF + "SELECT count(*) FILTER (action = 'inserted') inserted, count(*) FILTER (action = 'updated') updated, count(*) FILTER (action = 'missing') missing FROM d")
def snapshot_counts(spark, sf_dir):
    return sync.counts(sync.diff(*_snapshots(spark, sf_dir)))


@query(
    _DIFF.replace("d AS (SELECT", "d AS (SELECT u.k uk, u.p up, c.p cp, c.gone,")
    + "SELECT record_key, CASE WHEN uk IS NULL THEN cp ELSE up END price, uk IS NULL missing, CASE WHEN uk IS NULL AND gone THEN 's1' ELSE 's2' END last_sync_id, CASE action WHEN 'unchanged' THEN 1 ELSE 2 END updated FROM d"
)
def narrow_sync(spark, sf_dir):
    """The corpus after an upload of which few keys differ: only these keys' rows are joined."""
    upload, current = _snapshots(spark, sf_dir)
    current = current.select("*", F.lit("s1").alias("last_sync_id"), F.lit(1).alias("created_at"), F.lit(1).alias("updated_at"))
    changed = sync.actions(upload, current)
    changes = sync.changes_of(upload, current, changed)
    after = sync.apply(changes, upload.schema, sync_id="s2", now=F.lit(2))
    both = after.unionByName(sync.carried(current, changed, sync_id="s2").select(after.columns))
    return both.select("record_key", "price", F.col("missing_in_latest_upload").alias("missing"), "last_sync_id", F.col("updated_at").alias("updated"))


@query("SELECT CAST(o_orderkey AS VARCHAR) record_key, o_orderkey % 3 = 0 missing, CASE WHEN o_orderkey % 3 = 0 THEN 's2' ELSE 's3' END last_sync_id, CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END updated FROM orders")
def missing_reappear(spark, sf_dir):
    """Three uploads: all; only keys with remainder 2 by 3; then all but remainder 0."""
    o = a.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("record_key"), F.col("o_orderkey").alias("k"))
    state = o.select("*", F.lit(False).alias("missing_in_latest_upload"), F.lit("s1").alias("last_sync_id"), F.lit(1).alias("created_at"), F.lit(1).alias("updated_at"))
    for n, keep in ((2, "k % 3 = 2"), (3, "k % 3 <> 0")):
        state = sync.apply(sync.diff(o.where(keep), state), o.schema, sync_id=f"s{n}", now=F.lit(n))
    return state.select("record_key", F.col("missing_in_latest_upload").alias("missing"), "last_sync_id", F.col("updated_at").alias("updated"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def insert_if_absent(spark, sf_dir):
    new = a.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    there = a.table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return sync.absent(new, there, ["o_orderkey"])


_LAST = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(f'{c} DESC' for c in _LAST)}) rn FROM lineitem) WHERE rn = 1")
def keep_last_dedup(spark, sf_dir):
    rows = a.table(spark, sf_dir, "lineitem")
    return sync.keep_last(rows, ["l_orderkey", "l_linenumber"], _LAST).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")


_CANON = """'{"lang": ' || coalesce(to_json(lang)::VARCHAR, 'null') || ', "source": null, "text": ' || coalesce(to_json(text)::VARCHAR, 'null') || '}'"""


@query(f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'wo:' || CAST(doc_id AS VARCHAR) ELSE 'fp:' || sha256({_CANON}) END record_key FROM documents")
def record_key_fingerprint(spark, sf_dir):
    docs = a.table(spark, sf_dir, "documents")
    number = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("　 "), F.col("doc_id").cast("string"), F.lit(" "))).otherwise("  ")
    return docs.select("doc_id", keys.record_key(number, {"text": F.col("text"), "lang": F.col("lang"), "source": F.lit(None).cast("string")}).alias("record_key"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, event_type AS kept, CASE WHEN event_id % 2 = 0 THEN 'given' ELSE 'default' END AS filled, event_id % 2 = 0 AS has_it FROM events")
def raw_map_defaults(spark, sf_dir):
    rows = a.table(spark, sf_dir, "events").withColumn("raw", F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("t"), F.col("event_type"))))
    rows = rows.withColumn("raw", F.when(F.col("event_id") % 2 == 0, F.map_concat("raw", F.create_map(F.lit("d"), F.lit("given")))).otherwise(F.col("raw")))
    full = normalize.with_defaults(F.col("raw"), {"d": F.lit("default"), "t": F.lit("other")})
    return rows.withColumn("full", full).select("event_id", normalize.raw_value(F.col("full"), "x", "k").alias("k"), F.col("full")["t"].alias("kept"), F.col("full")["d"].alias("filled"), F.map_contains_key("raw", F.lit("d")).alias("has_it"))


_WORDS = (("licence", ("license", "rights reserved")), ("insult", ("idiot", "moron")), ("contact", ("@",)))


@query("SELECT doc_id, CASE WHEN contains(text, 'license') OR contains(text, 'rights reserved') THEN 'licence' WHEN contains(text, 'idiot') OR contains(text, 'moron') THEN 'insult' WHEN contains(text, '@') THEN 'contact' END family FROM documents")
def issue_family(spark, sf_dir):
    return a.table(spark, sf_dir, "documents").select("doc_id", text.issue_family(F.col("text"), families=_WORDS).alias("family"))


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'food_safety' WHEN '2-HIGH' THEN 'wage' WHEN '3-MEDIUM' THEN 'product_quality' END family FROM orders")
def issue_family_default(spark, sf_dir):
    """The rule pack's own families; the first in its order wins over words of later ones."""
    words = F.element_at(F.create_map(*(F.lit(x) for x in ("1-URGENT", "拖欠工资，食品卫生差", "2-HIGH", "农民工工资、产品质量", "3-MEDIUM", "商品质量问题"))), F.col("o_orderpriority"))
    orders = a.table(spark, sf_dir, "orders").select("o_orderkey", words.alias("words"))
    return orders.select("o_orderkey", text.issue_family(F.lit("标题"), F.lit(None).cast("string"), F.col("words")).alias("family"))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) - INTERVAL 8 HOUR AS day_start, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 16 HOUR AS day_end FROM orders")
def local_windows(spark, sf_dir):
    """Where the local day of each order begins and ends, as instants; the end is exclusive."""
    day = F.col("o_orderdate").cast("date")
    return a.table(spark, sf_dir, "orders").select("o_orderkey", dates.local_start(day).cast("timestamp_ntz").alias("day_start"), dates.local_start(F.date_add(day, 1)).cast("timestamp_ntz").alias("day_end"))


@query(f"WITH {a.GROUPED} SELECT count(*) total, CAST(ceil(count(*) / 20.0) AS BIGINT) pages, least(3, CAST(ceil(count(*) / 20.0) AS BIGINT)) AS page FROM grouped")
def event_page_count(spark, sf_dir):
    return library.page_count(a.summaries(spark, sf_dir), 3)


@query("SELECT doc_id, length(t) n, sha256(t) h FROM (SELECT doc_id, trim(regexp_replace(replace(coalesce(text, ''), chr(13), ''), '[\\s\\x{3000}]+', ' ', 'g')) t FROM documents)")
def collapse_text(spark, sf_dir):
    rows = a.table(spark, sf_dir, "documents").select("doc_id", text.collapse(F.col("text")).alias("t"))
    return rows.select("doc_id", F.length("t").cast("long").alias("n"), F.sha2(F.col("t").cast("binary"), 256).alias("h"))


for _run, _sql in (fields.ALL | roundtrips.ALL | service.ALL).items():
    query(_sql)(_run)
