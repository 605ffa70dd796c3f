"""Queries that write files or a store and read them back through the operators, with their SQL."""

from __future__ import annotations

import functools
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import rules
from ..functions.text import earlier_orders, issue_segments, occurrences
from ..operators import keywords, library, normalize, review
from ..schemas import RECORD
from ..sources import files, xlsx_sink
from ..sources.store import Scratch, Store, scratch
from . import adapter as a


def _one_file(df: DataFrame, path: str, **options) -> str:
    """`df` as one CSV file with a header, rows in order. Tasks write its ranges, whose bytes are then
    streamed into the file one after the other."""
    given = {"header": True, "quoteAll": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"'} | options
    folders = [f"{path}.parts"]
    df.write.csv(folders[0], **(given | {"header": False}))
    if given["header"]:
        folders.insert(0, f"{path}.head")
        df.sparkSession.createDataFrame([], df.schema).coalesce(1).write.csv(folders[0], **given)
    return files.join(df.sparkSession, folders, path)


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers under the headers of an export, in the order of their keys; a comment with a
    line feed and quotes, and tokens for missing values."""
    c = a.table(spark, sf_dir, "customer").orderBy("c_custkey")
    odd = F.when(F.col("c_custkey") % 5 == 0, "N/A").when(F.col("c_custkey") % 5 == 1, "").otherwise(F.concat(F.lit('说 "'), "c_mktsegment", F.lit('"\n,第二行')))
    return c.select(F.col("c_custkey").cast("string").alias("工单编号 "), F.col("c_name").alias("诉求标题"), odd.alias("市民诉求"), F.col("c_mktsegment").alias("所属部门"), F.lit("x").alias("Unnamed: 37"))


_RECORDS = """SELECT CAST(row_number() OVER (ORDER BY c_custkey) + 1 AS INTEGER) source_row, CAST(c_custkey AS VARCHAR) work_order_id, c_name title,
  CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE '说 "' || c_mktsegment || '"' || chr(10) || ',第二行' END appeal_text, c_mktsegment department, 4 n_raw FROM customer"""


def _shown(records: DataFrame) -> DataFrame:
    return records.select("source_row", "work_order_id", "title", "appeal_text", F.col("raw_fields")["所属部门"].alias("department"), F.size("raw_fields").alias("n_raw"))


def csv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _one_file(_exported(spark, sf_dir), scratch(spark, "export") + ".csv")
    return _shown(files.load_records(spark, path, max_rows=None))


def csv_records_gb18030(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    path = _one_file(_exported(spark, sf_dir), scratch(spark, "export") + ".csv", encoding="gb18030")
    return _shown(files.load_records(spark, path, max_rows=None))


#: Bytes of a range at least, and ranges of a larger file, about.
LEAST_RANGE, MOST_RANGES = 1 << 14, 256


def _range_size(length: int) -> int:
    """Bytes of each range, so that small files have many and large ones no more than tasks can bear."""
    return max(LEAST_RANGE, -(-length // MOST_RANGES))


@contextmanager
def _ranges(spark: SparkSession, path: str):
    """The file is read in ranges of `_range_size`, at most as long as Spark's own."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    for k in keys:
        spark.conf.set(k, str(min(most, _range_size(files.length(spark, path)))))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def csv_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in one file that many tasks read: quoted cells with line feeds, doubled quotes and
    commas, blank lines within cells, and quotes that open nothing."""
    o = a.table(spark, sf_dir, "orders").orderBy("o_orderkey")
    note = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('a "b"\n\n,'), "o_orderpriority", F.lit('\r\n"'))).when(F.col("o_orderkey") % 3 == 1, F.concat("o_orderpriority", F.lit(' 5" pipe')))
    rows = o.select(F.col("o_orderkey").cast("string").alias("编号"), note.alias("标题"), F.concat(F.lit("说,"), "o_orderstatus").alias("内容"))
    path = _one_file(rows, scratch(spark, "export") + ".csv")
    with _ranges(spark, path):
        found = files.scan_csv(spark, path)
    return found.frame.select("__row", F.col("编号").alias("k"), F.col("标题").alias("note"), F.col("内容").alias("status"), F.lit(found.total).cast("long").alias("n"), F.lit(found.ranges > 1).alias("parted"))


def _workbook(spark: SparkSession, sf_dir: str) -> str:
    """Two sheets: regions, and nations with a missing value and a formula-like text."""
    r, n = a.table(spark, sf_dir, "region"), a.table(spark, sf_dir, "nation")
    band = F.lit(0).alias("__band")
    regions = r.select(F.col("r_regionkey").alias("__key"), band, F.col("r_regionkey").alias("r"), F.col("r_name").alias("name"))
    name = F.when(F.col("n_nationkey") != 3, F.col("n_name"))
    nations = n.select(F.col("n_nationkey").alias("__key"), band, F.col("n_nationkey").alias("工单编号"), name.alias("诉求标题"), F.concat(F.lit("地址："), "n_name", F.lit(" <&>")).alias("市民诉求"))
    sheets = {"地区": (["r", "name"], regions), "国家": (["工单编号", "诉求标题", "市民诉求"], nations)}
    return xlsx_sink.write(scratch(spark, "book") + ".xlsx", sheets, ["__key"], "__band")


def workbook_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events with target records in a workbook that tasks write, read back sheet by sheet. A sheet
    that is full goes on in further ones."""
    with Scratch(spark) as owner:
        rows = a.event_members(spark, sf_dir).withColumn("raw_json", F.create_map(F.lit("=note"), F.concat(F.lit("="), "work_order_id", F.lit(" <&\n>"))))
        rows = owner.staged(rows, "members")
        chosen = library.summaries(rows, library.EventFilters(has_target_records=True))
        headers = ["工单编号", "诉求标题", "=note"]
        out = owner.staged(review.sheets(owner.staged(review.export_rows(rows, chosen)), headers), "rows")
        shown = list(rules.LEAD_HEADERS) + headers
        path = xlsx_sink.write(scratch(spark, "export") + ".xlsx", {name: (shown, out.where(F.col("sheet") == name)) for name in rules.SHEETS}, ["event_id", "record_key"], "band", spread=True)
    read = [files.read_sheet(spark, path, name, continued=True).select(F.lit(name).alias("sheet"), F.col("__row").alias("row_no"), "数据侧", "事件名称", F.col("工单编号").alias("id"), F.col("诉求标题").alias("title"), F.col("=note").alias("note")) for name in rules.SHEETS]
    return read[0].union(read[1])


def workbook_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _workbook(spark, sf_dir)
    first = files.read_sheet(spark, path).select(F.lit("地区").alias("sheet"), F.col("__row").alias("row_no"), F.col("r").alias("k"), "name", F.lit(None).cast("string").alias("more"))
    second = files.read_sheet(spark, path, "国家").select(F.lit("国家"), "__row", "工单编号", "诉求标题", "市民诉求")
    return first.union(second)


def file_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a CSV file and a workbook: format, sheets, their rows and columns, the column that is
    suggested for the work order's id, and the rows of a preview of one."""
    paths = (_one_file(_exported(spark, sf_dir), scratch(spark, "export") + ".csv"), _workbook(spark, sf_dir))
    first, second = (files.inspection(spark, path, preview_rows=1) for path in paths)
    return first.union(second)


def upload_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of an upload's copy is the hash of the bytes that were written: an order a line."""
    rows = a.table(spark, sf_dir, "orders").orderBy("o_orderkey").select(F.concat_ws(";", F.col("o_orderkey").cast("string"), "o_orderpriority").alias("line"))
    source = _one_file(rows, scratch(spark, "source") + ".csv", header=False, quoteAll=False)
    kept, digest = files.land(spark, source, scratch(spark, "uploads"))
    name = kept.rsplit("/", 1)[-1]
    named = len(name) == 33 + len(source.rsplit("/", 1)[-1]) and name.endswith("_" + source.rsplit("/", 1)[-1])
    return spark.read.text(kept).agg(F.count("*").alias("n")).select("n", F.lit(digest).alias("file_hash"), F.lit(named).alias("named"))


#: Words of all lengths, in fields of members and of events, and some that stand nowhere.
WORDS = ("customer#000000012", "#00000001", "urgent", "1-urg", "furn", "asia", "n", "7", "er#", "order 1", "食品", "食品安全", "欠薪", "not spe", "｜", "nation_7", "europe｜", "zzz", "rder 99", "machinery")


def keyword_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty words looked up in one index of all members and events."""
    owner = Scratch(spark)
    rows = owner.staged(a.members(spark, sf_dir).drop("anchor", "organization_subject"), "rows")
    kept = library.kept_summaries(rows, library.Layout(by=("event_key",), name=F.col("named")))
    members = rows.select("event_key", *library.SEARCHED).join(kept.select("event_key", "event_id"), "event_key").drop("event_key")
    members = owner.staged(members, "members")
    index = owner.staged(keywords.build(members, kept), "keywords")
    return keywords.lookup(members, kept, index, WORDS, owner)


def settled_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries that are kept while the first records of events 2 to 41 move into event 1, which is
    given a name in between; only touched events are worked out anew."""
    engine = Engine(spark, scratch(spark, "corpus"))
    engine.sync_records(records(spark, sf_dir), file_name="orders.csv")
    run = engine.compare(time_field="received_at", target_from=a.TARGET.target_from, target_to=a.TARGET.target_to).comparison_id
    firsts = engine.members(run).where("event_id between 2 and 41").groupBy("event_id").agg(F.min("record_key").alias("record_key"))
    moves = [{"kind": "move", "event_id": r["event_id"], "record_key": r["record_key"], "to_event": 1} for r in firsts.orderBy("event_id").collect()]  # forty rows
    for some in (moves[:20], moves[20:]):
        engine.event_summaries(run)
        engine._override(run, some, engine.store.version())
        engine.update_event_name(1, "all of them", comparison_id=run)
    return engine.event_summaries(run).select("event_id", "event_name", "member_count", "target_count")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records of a complaint form."""
    o = a.dealt(a.table(spark, sf_dir, "orders")).join(a.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    day = lambda f: F.date_format("o_orderdate", f)
    raw = F.create_map(F.lit("事项分类"), F.col("o_orderpriority"), F.lit("所属部门"), F.col("c_mktsegment"), F.lit("事发地点"), F.lit("礼乐"), F.lit("办结时间"), F.when(F.col("o_orderstatus") != "O", F.concat(day("yyyy/M/d"), F.lit(" 20:30:00"))))
    appeal = F.concat(F.lit("地址：江海区礼乐街道"), "c_name", F.lit("门口。\n事项："), "o_orderpriority", F.lit("。"))
    given = {"work_order_id": F.col("o_orderkey").cast("string"), "title": F.concat(F.lit("[热线]反映"), "c_name", F.lit("积水的问题")), "appeal_text": appeal, "received_at": day("yyyy-MM-dd"), "raw_fields": raw, "source_row": F.col("o_orderkey").cast("int")}
    return o.select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RECORD.fields)).to(RECORD)


_ANCHOR = "replace(c_name, ' ', '') || '门口'"
_NORMAL = "orders JOIN customer ON o_custkey = c_custkey"


def normalized_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = normalize.normalize(records(spark, sf_dir))
    plain = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return out.select("record_key", plain("received_at"), plain("completed_at"), "title_normalized", "category", "department", "processing_department", "location", "region", "street", "anchor", "organization_subject", "issue_family", "event_key", F.col("raw_json")["处理部门"].alias("raw_department"), F.col("raw_json")["受理时间"].alias("raw_received"))


def parsed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parse of a house address made of each order's customer and keys."""
    o = a.dealt(a.table(spark, sf_dir, "orders")).select("o_orderkey", "o_custkey")
    appeal = F.concat(F.lit("地址：新会区会城街道仁义路"), F.col("o_custkey").cast("string"), F.lit("号"), ((F.col("o_orderkey") % 9) + 1).cast("string"), F.lit("幢二十"), F.lit("楼。\n备注：此前工单"), F.lpad(F.col("o_orderkey").cast("string"), 16, "0"), F.lit("未解决"))
    rows = o.select("o_orderkey", appeal.alias("appeal_text"), F.lit("").alias("location"), F.lit(None).cast("string").alias("title"))
    p = lambda c: F.col(f"parsed.{c}").cast("string").alias(c)
    return normalize.parse_complaint(rows).select("o_orderkey", *(p(c) for c in ("region", "street", "road", "house_no", "building", "floor", "parse_source", "parse_confidence")), F.array_join("parsed.previous_work_order_ids", ",").alias("earlier"))


def order_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = a.table(spark, sf_dir, "orders")
    key = F.lpad(F.col("o_orderkey").cast("string"), 16, "0")
    text = F.concat(F.lit("此前工单"), key, F.lit("，订单号：ab-"), F.lpad(F.col("o_custkey").cast("string"), 8, "0"), F.lit("，投诉单号："), key, F.lit("，订单号：AB"), F.lpad(F.col("o_custkey").cast("string"), 8, "0"))
    return o.select("o_orderkey", F.array_join(earlier_orders(text), ",").alias("earlier"), F.array_join(occurrences(text), ",").alias("found"))


def order_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("前言 事项一："), "o_orderpriority", F.lit("\n事项2 : "), "o_orderstatus", F.lit(" 事项： 事项三:"))
    shown = F.transform(issue_segments(text), lambda s: F.concat_ws("/", s["segment_no"].cast("string"), F.coalesce(s["label"], F.lit("-")), s["text"]))
    return a.table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(shown, ";").alias("segments"))


def missing_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of orders, every other one a token for a missing value or nearly one."""
    tokens = ["N/A", "nan", "NULL", "na", " NA", "<NA>", "-1.#IND", "none"]
    cell = F.when(F.col("o_orderkey") % 2 == 0, F.element_at(F.array(*map(F.lit, tokens)), (F.col("o_orderkey") % len(tokens) + 1).cast("int"))).otherwise(F.col("o_orderstatus"))
    return a.table(spark, sf_dir, "orders").select("o_orderkey", files.null_tokens(cell).alias("cell"))


def stored_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store after two versions: orders replaced, events appended twice."""
    store = Store(spark, scratch(spark, "store"))
    orders, events = (a.table(spark, sf_dir, t) for t in ("orders", "events"))
    store.commit(replace={"orders": store.stage("orders", orders.limit(1))}, append={"events": store.stage("events", events)})
    store.commit(replace={"orders": store.stage("orders", orders)}, append={"events": store.stage("events", events)}, base=store.version())
    of = lambda t, df: store.read(t, df.schema).agg(F.lit(t).alias("stored"), F.count("*").alias("n"))
    return of("orders", orders).union(of("events", events)).withColumn("version", F.lit(store.version()).cast("long"))


def engine_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus after two uploads, the first without keys that end with 7."""
    engine = Engine(spark, scratch(spark, "corpus"))
    engine.sync_records(records(spark, sf_dir).where("work_order_id not like '%7'"), file_name="first.csv")
    engine.sync_records(records(spark, sf_dir), file_name="orders.csv")
    runs = engine.list_sync_runs().select(F.col("id").alias("last_sync_id"), "file_name", "inserted_rows", "updated_rows", F.array_join("business_columns", ",").alias("headers"))
    rows = engine.list_current_orders().join(F.broadcast(runs), "last_sync_id")
    return rows.select("record_key", "event_key", "missing_in_latest_upload", "file_name", "inserted_rows", "updated_rows", "headers", F.lit(engine.count_current_orders()).alias("n"), F.lit(str(engine.latest_local_date("received_at"))).alias("latest"))


def engine_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, scratch(spark, "corpus"))
    engine.sync_records(records(spark, sf_dir), file_name="orders.csv")
    out = engine.compare(time_field="received_at", target_from=a.TARGET.target_from, target_to=a.TARGET.target_to)
    counts = [F.lit(getattr(out, k)).cast("long").alias(k) for k in ("event_count", "singleton_count", "missing_time_count")]
    return engine.event_summaries(out.comparison_id).select("event_id", "event_name", "region", "street_name", "issue_name", "member_count", "target_count", *counts)


_KEY = f"'ordinary|江海区|礼乐街道|' || lower({_ANCHOR}) || '|' || lower(replace(o_orderpriority, ' ', ''))"


def events_sql(where: str = "") -> str:
    """Members (m) and events (g) of a comparison of the records of orders, in SQL."""
    return f"""WITH m AS (SELECT 'wo:' || CAST(o_orderkey AS VARCHAR) record_key, {_KEY} event_key, '江海区｜礼乐街道｜' || {_ANCHOR} || '｜' || o_orderpriority event_name, o_orderpriority issue_name,
  CASE WHEN CAST(o_orderdate AS DATE) BETWEEN '{a.TARGET.target_from}' AND '{a.TARGET.target_to}' THEN 0 ELSE 1 END side FROM {_NORMAL} {where}),
g AS (SELECT event_key, event_name, issue_name, count(*) member_count, count(*) FILTER (side = 0) target_count, min(side) AS s, min(record_key) FILTER (side = 0) AS r0, min(record_key) r1 FROM m GROUP BY ALL)"""


_EVENTS = events_sql()

#: Each query with its SQL.
ALL = {
    csv_records: _RECORDS,
    csv_records_gb18030: _RECORDS,
    workbook_sheets: "SELECT '地区' sheet, CAST(row_number() OVER (ORDER BY r_regionkey) + 1 AS INTEGER) row_no, CAST(r_regionkey AS VARCHAR) k, r_name AS name, NULL more FROM region UNION ALL SELECT '国家', CAST(row_number() OVER (ORDER BY n_nationkey) + 1 AS INTEGER), CAST(n_nationkey AS VARCHAR), CASE WHEN n_nationkey <> 3 THEN n_name END, '地址：' || n_name || ' <&>' FROM nation",
    csv_ranges: "SELECT CAST(row_number() OVER (ORDER BY o_orderkey) + 1 AS INTEGER) __row, CAST(o_orderkey AS VARCHAR) k, CASE o_orderkey % 3 WHEN 0 THEN 'a \"b\"' || chr(10) || chr(10) || ',' || o_orderpriority || chr(13) || chr(10) || '\"' WHEN 1 THEN o_orderpriority || ' 5\" pipe' END note, '说,' || o_orderstatus status, count(*) OVER () n, true parted FROM orders",
    workbook_export: f"WITH {a.GROUPED}, rows AS (SELECT m.*, CASE WHEN count(*) OVER (PARTITION BY event_id) > 1 THEN '重复项' ELSE '孤立工单' END sheet FROM event_members m WHERE event_id IN (SELECT event_id FROM grouped WHERE target_count > 0)) SELECT sheet, CAST(row_number() OVER (PARTITION BY sheet ORDER BY event_id, record_key) + 1 AS INTEGER) row_no, CASE side WHEN 'target' THEN '待比对' ELSE '被比对' END AS 数据侧, event_name AS 事件名称, work_order_id AS id, title_raw AS title, chr(39) || '=' || work_order_id || ' <&' || chr(10) || '>' AS note FROM rows",
    keyword_index: f"WITH {a.SUMMARY}, words AS (SELECT unnest([{', '.join(f'$${w}$$' for w in WORDS)}]) word), said AS (SELECT event_id, string_agg(lower(concat_ws('|', work_order_id, title_raw, appeal_text, department, processing_department)), chr(10)) t FROM event_members GROUP BY event_id) SELECT word, s.event_id FROM words, summary s JOIN said USING (event_id) WHERE contains(t, word) OR contains(lower(concat_ws(chr(10), event_name, issue_name, region, street_name, departments)), word)",
    settled_moves: f"{_EVENTS}, n AS (SELECT row_number() OVER (ORDER BY s, CASE WHEN s = 0 THEN r0 ELSE r1 END) event_id, event_key, event_name FROM g), p AS (SELECT n.event_id, n.event_name, m.side, CASE WHEN n.event_id BETWEEN 2 AND 41 AND m.record_key = min(m.record_key) OVER (PARTITION BY n.event_id) THEN 1 ELSE n.event_id END now FROM m JOIN n USING (event_key)), q AS (SELECT now, count(*) member_count, count(*) FILTER (side = 0) target_count FROM p GROUP BY now) SELECT event_id, CASE WHEN event_id = 1 THEN 'all of them' ELSE event_name END event_name, member_count, target_count FROM q JOIN n ON now = event_id",
    file_inspection: "SELECT 'csv' AS format, 'CSV' sheet, (SELECT count(*) FROM customer) n, 5 AS columns, '工单编号 ' id_column, 'utf-8' AS encoding, 1 shown UNION ALL SELECT 'xlsx', '地区', (SELECT count(*) FROM region), 2, NULL, NULL, 1 UNION ALL SELECT 'xlsx', '国家', (SELECT count(*) FROM nation), 3, '工单编号', NULL, 1",
    upload_landing: "SELECT count(*) n, sha256(string_agg(o_orderkey || ';' || o_orderpriority || chr(10), '' ORDER BY o_orderkey)) file_hash, true AS named FROM orders",
    normalized_records: f"""SELECT 'wo:' || CAST(o_orderkey AS VARCHAR) record_key, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) - INTERVAL 8 HOUR received_at, CASE WHEN o_orderstatus <> 'O' THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 750 MINUTE END completed_at,
  c_name || '积水' title_normalized, o_orderpriority category, c_mktsegment department, c_mktsegment processing_department, '礼乐' AS location, '江海区' region, '礼乐街道' street, {_ANCHOR} anchor, '' organization_subject, NULL issue_family, {_KEY} event_key, c_mktsegment raw_department, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) raw_received FROM {_NORMAL}""",
    parsed_records: "SELECT o_orderkey, '新会区' region, '会城街道' street, '仁义路' road, CAST(o_custkey AS VARCHAR) || '号' house_no, CAST(o_orderkey % 9 + 1 AS VARCHAR) || '幢' building, '20楼' AS floor, 'appeal_address' parse_source, '0.95' parse_confidence, lpad(CAST(o_orderkey AS VARCHAR), 16, '0') earlier FROM orders",
    order_identifiers: "SELECT o_orderkey, k earlier, 'order:AB' || c || ',complaint:' || k AS found FROM (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 16, '0') k, lpad(CAST(o_custkey AS VARCHAR), 8, '0') c FROM orders)",
    order_segments: "SELECT o_orderkey, '1/一/' || o_orderpriority || ';2/2/' || o_orderstatus segments FROM orders",
    missing_tokens: "SELECT o_orderkey, CASE WHEN o_orderkey % 2 <> 0 THEN o_orderstatus WHEN o_orderkey % 8 = 4 THEN ' NA' END cell FROM orders",
    stored_tables: "SELECT 'orders' AS stored, count(*) n, 2 AS version FROM orders UNION ALL SELECT 'events', 2 * count(*), 2 FROM events",
    engine_corpus: f"""SELECT 'wo:' || CAST(o_orderkey AS VARCHAR) record_key, {_KEY} event_key, false missing_in_latest_upload, 'orders.csv' file_name, count(*) FILTER (o_orderkey % 10 = 7) OVER () inserted_rows, 0 updated_rows,
  '事项分类,所属部门,事发地点,办结时间' headers, count(*) OVER () n, CAST(CAST(max(o_orderdate) OVER () AS DATE) AS VARCHAR) AS latest FROM {_NORMAL}""",
    engine_events: f"{_EVENTS} SELECT row_number() OVER (ORDER BY s, CASE WHEN s = 0 THEN r0 ELSE r1 END) event_id, event_name, '江海区' region, '礼乐街道' street_name, issue_name, member_count, target_count, count(*) OVER () event_count, count(*) FILTER (member_count = 1) OVER () singleton_count, 0 missing_time_count FROM g",
}
