"""Work orders made from the star-schema tables, the same way for Spark and for SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import events, library, windows
from ..sources.store import staged

TARGET = windows.Windows("received_at", date(1998, 1, 1), date(1998, 12, 31))
MANUAL = windows.Windows("received_at", date(1998, 1, 1), date(1998, 12, 31), date(1996, 3, 1), date(1997, 6, 30))
FAMILIES = {"FURNITURE": "food_safety", "MACHINERY": "wage"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """A table of fewer files than there are cores, dealt to all of them, as what follows costs more
    a row than moving it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)


def work_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with customer, nation and region, completed at their last shipment unless open."""
    t = lambda name: table(spark, sf_dir, name)
    shipped = t("lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    joined = (
        dealt(t("orders"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    )
    number = F.col("o_orderkey").cast("string")
    family = F.coalesce(*(F.when(F.col("c_mktsegment") == k, F.lit(v)) for k, v in FAMILIES.items()))
    return joined.select(
        F.concat(F.lit("wo:"), number).alias("record_key"),
        number.alias("work_order_id"),
        F.col("o_orderdate").cast("timestamp").alias("received_at"),
        F.when(F.col("o_orderstatus") != "O", F.col("shipped").cast("timestamp")).alias("completed_at"),
        F.concat(F.lit("order "), number).alias("title_raw"),
        F.concat_ws(" ", "c_name", "o_orderpriority").alias("appeal_text"),
        F.col("o_orderpriority").alias("category"),
        F.col("c_mktsegment").alias("processing_department"),
        F.col("o_orderstatus").alias("department"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("street"),
        F.col("c_name").alias("anchor"),
        F.lower("c_name").alias("organization_subject"),
        family.alias("issue_family"),
        F.col("o_totalprice").alias("price"),
    )


def issue() -> Column:
    return keys.issue_name(F.col("issue_family"), F.col("category"))


def members(spark: SparkSession, sf_dir: str, w: windows.Windows = TARGET) -> DataFrame:
    """Sided work orders with event key and event name."""
    c = F.col
    rows = windows.assign_sides(work_orders(spark, sf_dir), w)
    keyed = rows.withColumn("event_key", keys.event_key(c("region"), c("street"), c("anchor"), c("category"), c("organization_subject"), c("issue_family"), c("record_key")))
    return keyed.withColumn("named", keys.event_name(c("region"), c("street"), c("organization_subject"), c("anchor"), c("title_raw"), c("event_key"), issue()))


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.group_events(members(spark, sf_dir), F.col("named"))


def event_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members with the id and name of their event."""
    rows = staged(members(spark, sf_dir), "members")
    return rows.join(events.group_events(rows, F.col("named")).select("event_id", "event_key", "event_name"), "event_key")


def summaries(spark: SparkSession, sf_dir: str, filters: library.EventFilters | None = None) -> DataFrame:
    """Summaries of the events that pass; grouping, numbering and summing up are one aggregation."""
    return library.summaries(members(spark, sf_dir), filters, library.Layout(by=("event_key",), name=F.col("named"))).drop("event_key")


# -- the same in SQL --------------------------------------------------------------------

DAY = "CAST({} + INTERVAL 8 HOUR AS DATE)"
ISSUE = "CASE issue_family WHEN 'food_safety' THEN '食品安全' WHEN 'wage' THEN '欠薪' ELSE coalesce(nullif(category, ''), '未分类') END"


def part(x: str) -> str:
    return f"coalesce(nullif(lower(regexp_replace({x}, '\\s+', '', 'g')), ''), '-')"


def _joined(kind: str, *parts: str) -> str:
    return f"'{kind}'" + "".join(f" || '|' || {part(p)}" for p in parts)


WO = """wo AS (SELECT 'wo:' || CAST(o_orderkey AS VARCHAR) record_key, CAST(o_orderkey AS VARCHAR) work_order_id,
  o_orderdate received_at, CASE WHEN o_orderstatus <> 'O' THEN shipped END completed_at,
  'order ' || CAST(o_orderkey AS VARCHAR) title_raw, c_name || ' ' || o_orderpriority appeal_text, o_orderpriority category,
  c_mktsegment processing_department, o_orderstatus department, r_name region, n_name street, c_name anchor,
  lower(c_name) organization_subject,
  CASE c_mktsegment WHEN 'FURNITURE' THEN 'food_safety' WHEN 'MACHINERY' THEN 'wage' END issue_family, o_totalprice price
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT l_orderkey, max(l_shipdate) shipped FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"""


def sided(w: windows.Windows = TARGET) -> str:
    day = DAY.format(w.time_field)
    other = f"WHEN {day} BETWEEN '{w.reference_from}' AND '{w.reference_to}' THEN 'reference'" if w.manual else "ELSE 'reference'"
    return f"{WO}, sided AS (SELECT * FROM (SELECT *, CASE WHEN {w.time_field} IS NULL OR {day} BETWEEN '{w.target_from}' AND '{w.target_to}' THEN 'target' {other} END side FROM wo) WHERE side IS NOT NULL)"


KEY = f"""CASE WHEN coalesce(issue_family, '') <> '' AND coalesce(organization_subject, '') <> '' THEN {_joined("enterprise", "region", "street", "organization_subject", "issue_family")}
  WHEN coalesce(issue_family, '') <> '' OR anchor = '未知地点' OR coalesce(category, '') = '' THEN {_joined("singleton", "record_key")}
  ELSE {_joined("ordinary", "region", "street", "anchor", "category")} END"""

MEMBERS = f"""{sided()}, keyed AS (SELECT *, {KEY} event_key, CASE side WHEN 'target' THEN 0 ELSE 1 END side_rank, {ISSUE} issue FROM sided),
members AS (SELECT *, region || '｜' || street || '｜' || CASE WHEN event_key LIKE 'singleton|%' THEN title_raw ELSE organization_subject END || '｜' || issue named FROM keyed)"""

GROUPED = f"""{MEMBERS}, firsts AS (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY side_rank, record_key) rn, count(*) OVER (PARTITION BY event_key) member_count,
  sum(CASE side WHEN 'target' THEN 1 ELSE 0 END) OVER (PARTITION BY event_key) target_count FROM members),
grouped AS (SELECT row_number() OVER (ORDER BY side_rank, record_key) event_id, event_key, named event_name, CAST(member_count AS BIGINT) member_count, CAST(target_count AS BIGINT) target_count,
  region, street street_name, issue issue_name FROM firsts WHERE rn = 1),
event_members AS (SELECT m.*, g.event_id, g.event_name FROM members m JOIN grouped g USING (event_key))"""

SUMMARY = f"""{GROUPED}, summary AS (SELECT g.event_id, g.event_name, g.region, g.street_name, g.issue_name, g.member_count, g.target_count,
  min(received_at) first_received_at, max(received_at) last_received_at, string_agg(DISTINCT processing_department, ',' ORDER BY processing_department) departments
  FROM grouped g JOIN event_members m ON g.event_id = m.event_id GROUP BY ALL)"""
