"""Queries of the text, date and key functions over fields made from the bundled tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import library, normalize, review
from . import adapter as a

def _k() -> Column:
    return F.col("o_orderkey")



def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer's name without blanks."""
    return a.table(spark, sf_dir, "orders").join(a.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("who", F.replace("c_name", F.lit("#"), F.lit("")))


def _join(*parts) -> Column:
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def _pick(n: int, *found) -> Column:
    """One of the given values, by the remainder of the order's key."""
    out = F.lit(None)
    for k, v in enumerate(found):
        out = F.when(_k() % n == k, v if isinstance(v, Column) else F.lit(v)).otherwise(out)
    return out.cast("string")


def _parsed(rows: DataFrame, *fields: str) -> DataFrame:
    full = normalize.parse_complaint(rows)
    return full.select("o_orderkey", *(F.col(f"parsed.{f}").cast("string").alias(f) for f in fields))


def address_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every component of an address, its street under a name that is given another."""
    appeal = _join("地址：新会区圭峰会城会城街道，仁义路", F.col("o_custkey"), "号", _k() % 9 + 1, "栋", _k() % 5 + 1, "单元", _k() % 700 + 1, "室，铺位B-", _k() % 30, "，", _k() % 20 + 1, "F。备注：转办")
    rows = a.table(spark, sf_dir, "orders").select("o_orderkey", appeal.alias("appeal_text"), F.lit(None).cast("string").alias("location"), F.lit("无").alias("title"))
    return _parsed(rows, "region", "street", "house_no", "building", "unit", "room", "shop_no", "floor", "parse_source")


def address_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of an address, its kind, and how sure the parse is, by where the address stands."""
    who = F.col("who")
    rows = _orders(spark, sf_dir).select(
        "o_orderkey",
        _pick(5, _join("投诉\n 地址二: 江海区外海镇", who, "对面;事项：积水"), F.lit(None), "", "无", "地址：_x000D_其他").alias("appeal_text"),
        _pick(5, "外海", _join(" 高新区礼乐镇东海路", _k(), "号", who, "　"), "  ", F.lit(None), "鹤山市").alias("location"),
        _pick(5, "外海", "礼乐", _join("台山市", who, "路口"), " ", "题").alias("title"),
    )
    return _parsed(rows, "region", "street", "anchor_raw", "anchor_type", "direction", "parse_source", "parse_confidence")


def street_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated suffixes of a street's name become one, and one name is given another."""
    given = _pick(4, _join(F.col("c_mktsegment"), "镇街道"), _join(F.col("c_mktsegment"), "乡镇街道"), "圭峰会城会城街道", F.col("c_mktsegment"))
    return _orders(spark, sf_dir).select("o_orderkey", text.normal_street(given).alias("street"))


def component_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numerals and digits of buildings and floors."""
    numeral = lambda c: F.substring(F.lit("一二三四五六七八九"), (c % 9 + 1).cast("int"), F.lit(1))
    given = _pick(6, _join(numeral(_k()), "十", numeral(_k() + 1), "棟"), _join("十", numeral(_k()), "幢"), _join("00", _k() % 9 + 1, "号厂房"), _join(_k() % 90, "f"), _join(numeral(_k()), "百楼"), _join(numeral(_k()), "层"))
    rows = a.table(spark, sf_dir, "orders").select("o_orderkey", given.alias("given"))
    return rows.select("o_orderkey", text.numbered_component(F.col("given")).alias("shown"))


def title_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = F.col("who")
    given = _pick(4, _join("[热线]（转）要求 反映", who, "积水的问题"), _join("投诉　 蓬江区", who, "噪音事项"), _join(who, "；，"), _join("【急】", who, "问题的答复"))
    return _orders(spark, sf_dir).select("o_orderkey", text.clean_title(given).alias("title"))


def organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as they stand and folded for comparison; the title's comes before the appeal's."""
    who = F.col("who")
    title = _pick(4, _join("举报", who, "股份有限公司欠薪"), "咨询某学校", _join("关于 江海区外海街道东宁路", _k(), "号ＡＢ", _k(), "集团公司"), F.lit(None))
    appeal = _pick(4, "另一家工厂", _join("在", who, "超市，购物"), F.lit(None), F.col("c_mktsegment"))
    found = text.organization(title, appeal)
    return _orders(spark, sf_dir).select("o_orderkey", found.alias("name"), text.normal_organization(found).alias("folded"))


def phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.lpad((_k() % 100_000_000).cast("string"), 8, "0")
    given = _pick(4, _join(" 138", F.substring(digits, 1, 4), "　", F.substring(digits, 5, 4)), _join("138*****", F.substring(digits, 5, 4)), _join("238", digits), F.lit(None))
    return a.table(spark, sf_dir, "orders").select("o_orderkey", text.phone(given).alias("p")).select("o_orderkey", "p.*")


def whole_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without a mark are one segment, empty ones none."""
    given = _pick(3, _join("  ", F.col("o_orderpriority"), "\r\n\t没有"), F.lit(None), "　")
    shown = F.transform(text.issue_segments(given), lambda s: F.concat_ws("/", s["segment_no"].cast("string"), F.coalesce(s["label"], F.lit("-")), s["text"], s["is_independent"].cast("string")))
    return a.table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(shown, ";").alias("segments"))


def timestamp_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day of each order in all forms that are read, and in some that aren't."""
    day = lambda f: F.date_format("o_orderdate", f)
    forms = (day("yyyy-MM-dd"), day("yyyy/M/d H:m:s"), day("yyyy.M.d"), day("yyyy-MM-dd'T06:30:00Z'"), day("yyyy-MM-dd' 06:30:00+02:00'"), day("yyyyMMdd"), day("yyyy-MM-dd' 08:30'"), day("yyyy-M"), day("yyyy-'13'-dd"), day("'　'yyyy-MM-dd'T08:30:05.25'"))
    return a.table(spark, sf_dir, "orders").select("o_orderkey", dates.parse_timestamp(_pick(len(forms), *forms)).cast("timestamp_ntz").alias("utc"))


def iso_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days named by ISO week, over 60 years of days, three years a day of an order."""
    day = F.date_add(F.lit("1992-01-01").cast("date"), (_k() % 21_915).cast("int"))
    monday = F.date_trunc("week", day).cast("date")
    year = F.year(F.date_add(monday, 3)).cast("string")
    week, nth = F.lpad(F.weekofyear(day).cast("string"), 2, "0"), (F.weekday(day) + 1).cast("string")
    given = _pick(4, _join(year, "-W", week, "-", nth), _join(year, "W", week, nth, "T08:00:00"), _join(year, "-W", week), _join(year, "-W54-", nth))
    return a.table(spark, sf_dir, "orders").select("o_orderkey", dates.parse_timestamp(given).cast("timestamp_ntz").alias("utc"))


def window_end_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last day of windows whose ends are stored as the instants after it."""
    return a.table(spark, sf_dir, "orders").select("o_orderkey", dates.end_day_text(F.col("o_orderdate").cast("timestamp")).alias("last_day"))


def fenced_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inside of fenced blocks; a fence within a text is left."""
    e = a.table(spark, sf_dir, "events")
    given = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" ```json\n"), "props", F.lit("\n``` \n"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("```"), "props", F.lit("```"))).otherwise(F.concat("props", F.lit("```x```")))
    return e.select("event_id", text.strip_code_fence(given).alias("inside"))


def safe_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = _pick(6, "=", "+", "-", "@", " =", "")
    return a.table(spark, sf_dir, "orders").select("o_orderkey", review.safe_cell(_join(lead, F.col("o_orderpriority"))).alias("cell"))


def job_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, kind = _pick(5, "queued", "running", "completed", "failed", F.col("o_orderstatus")), _pick(2, "sync", F.lit(None))
    return a.table(spark, sf_dir, "orders").select("o_orderkey", library.status_label(status).alias("status"), library.kind_label(kind).alias("kind"))


def _case(n: int, *found: str) -> str:
    return f"CASE o_orderkey % {n} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(found)) + " END"


_WHO = "replace(c_name, '#', '')"
_FROM = "orders JOIN customer ON o_custkey = c_custkey"
_NUMERAL = "substr('一二三四五六七八九', CAST({} % 9 AS INT) + 1, 1)"
_LOCAL = "CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)"
_DAY = "DATE '1992-01-01' + CAST(o_orderkey % 21915 AS INT)"

#: Each query with its SQL.
ALL = {
    address_components: "SELECT o_orderkey, '新会区' region, '会城街道' street, CAST(o_custkey AS VARCHAR) || '号' house_no, CAST(o_orderkey % 9 + 1 AS VARCHAR) || '栋' building, CAST(o_orderkey % 5 + 1 AS VARCHAR) || '单元' unit, CAST(o_orderkey % 700 + 1 AS VARCHAR) || '室' room, 'B-' || CAST(o_orderkey % 30 AS VARCHAR) shop_no, CAST(o_orderkey % 20 + 1 AS VARCHAR) || '楼' AS floor, 'appeal_address' parse_source FROM orders",
    address_anchors: f"""SELECT o_orderkey, {_case(5, "'江海区'", "'江海区'", "'台山市'", "NULL", "NULL")} region, {_case(5, "'外海街道'", "'礼乐街道'", "NULL", "NULL", "NULL")} street, {_case(5, f"'外海镇' || {_WHO} || '对面'", _WHO, f"{_WHO} || '路口'", "NULL", "'其他'")} anchor_raw,
  {_case(5, "'landmark'", "'subject'", "'landmark'", "'unknown'", "'subject'")} anchor_type, {_case(5, "'对面'", "NULL", "'路口'", "NULL", "NULL")} direction, {_case(5, "'appeal_address'", "'location'", "'title'", "'unknown'", "'appeal_address'")} parse_source, {_case(5, "'0.95'", "'0.75'", "'0.4'", "'0.4'", "'0.4'")} parse_confidence FROM {_FROM}""",
    street_forms: f"SELECT o_orderkey, {_case(4, 'c_mktsegment || $$镇$$', 'c_mktsegment || $$乡$$', '$$会城街道$$', 'c_mktsegment')} street FROM {_FROM}",
    component_numbers: f"SELECT o_orderkey, {_case(6, 'CAST((o_orderkey % 9 + 1) * 10 + (o_orderkey + 1) % 9 + 1 AS VARCHAR) || $$栋$$', 'CAST(10 + o_orderkey % 9 + 1 AS VARCHAR) || $$幢$$', 'CAST(o_orderkey % 9 + 1 AS VARCHAR) || $$号厂房$$', 'CAST(o_orderkey % 90 AS VARCHAR) || $$楼$$', _NUMERAL.format('o_orderkey') + ' || $$百楼$$', 'CAST(o_orderkey % 9 + 1 AS VARCHAR) || $$层$$')} shown FROM orders",
    title_forms: f"SELECT o_orderkey, {_case(4, f'{_WHO} || $$积水$$', f'{_WHO} || $$噪音$$', _WHO, f'$$【急】$$ || {_WHO} || $$问题的答复$$')} title FROM {_FROM}",
    organizations: f"SELECT o_orderkey, {_case(4, f'{_WHO} || $$股份有限公司$$', f'$$在$$ || {_WHO} || $$超市$$', '$$ＡＢ$$ || o_orderkey || $$集团公司$$', 'NULL')} AS name, {_case(4, f'lower({_WHO})', f'$$在$$ || lower({_WHO}) || $$超市$$', '$$ab$$ || o_orderkey', '$$$$')} folded FROM {_FROM}",
    phones: f"SELECT o_orderkey, {_case(4, '$$138$$ || d', 'NULL', 'NULL', 'NULL')} phone_exact, {_case(4, 'NULL', '$$138*****$$ || substr(d, 5)', 'NULL', 'NULL')} phone_mask_pattern, o_orderkey % 4 = 0 phone_is_valid FROM (SELECT o_orderkey, lpad(CAST(o_orderkey % 100000000 AS VARCHAR), 8, '0') d FROM orders)",
    whole_segments: f"SELECT o_orderkey, {_case(3, '$$1/-/$$ || o_orderpriority || $$ 没有/true$$', '$$$$', '$$$$')} segments FROM orders",
    timestamp_forms: f"SELECT o_orderkey, {_case(10, *(f'{_LOCAL} - INTERVAL 8 HOUR',) * 3, f'{_LOCAL} + INTERVAL 390 MINUTE', f'{_LOCAL} + INTERVAL 270 MINUTE', f'{_LOCAL} - INTERVAL 8 HOUR', f'{_LOCAL} + INTERVAL 30 MINUTE', 'NULL', 'NULL', f'{_LOCAL} + INTERVAL 30 MINUTE + INTERVAL 5250 MILLISECOND')} utc FROM orders",
    iso_weeks: f"SELECT o_orderkey, {_case(4, f'CAST({_DAY} AS TIMESTAMP) - INTERVAL 8 HOUR', f'CAST({_DAY} AS TIMESTAMP)', f'CAST(date_trunc($$week$$, {_DAY}) AS TIMESTAMP) - INTERVAL 8 HOUR', 'NULL')} utc FROM orders",
    window_end_days: f"SELECT o_orderkey, CAST({a.DAY.format('o_orderdate')} - 1 AS VARCHAR) last_day FROM orders",
    fenced_texts: "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN props || '```x```' ELSE props END inside FROM events",
    safe_cells: f"SELECT o_orderkey, {_case(6, *(f'$${chr(39)}{c}$$ || o_orderpriority' for c in '=+-@'), '$$ =$$ || o_orderpriority', 'o_orderpriority')} cell FROM orders",
    job_labels: f"SELECT o_orderkey, {_case(5, '$$待处理$$', '$$执行中$$', '$$已完成$$', '$$失败$$', '$$未知状态$$')} status, {_case(2, '$$全量同步$$', '$$时间窗口比对$$')} kind FROM orders",
}
