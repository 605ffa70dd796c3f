"""Raw records to normalized ones: one projection per level of dependency, no shuffle."""

from __future__ import annotations

import hashlib
import inspect
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates, keys, rules, text
from ..functions.dates import parse_timestamp
from ..schemas import PAYLOAD


def raw_value(raw: Column, *names: str) -> Column:
    """The first of the named source columns that is not empty."""
    return F.coalesce(*(text.none_if_empty(raw[n]) for n in names))


def with_defaults(raw: Column, defaults: dict[str, Column]) -> Column:
    """The map with each default whose key it lacks; a key that is there keeps even a null."""
    given = F.create_map(*(x for k, v in defaults.items() for x in (F.lit(k), v.cast("string"))))
    return F.map_concat(raw, F.map_filter(given, lambda k, v: ~F.map_contains_key(raw, k)))


def fallback(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(text.none_if_empty(c) for c in columns))


def with_parse(df: DataFrame, *, title: str = "title", appeal: str = "appeal_text", location: str = "location") -> DataFrame:
    """Adds what a complaint is parsed into as columns p_..., so that those nobody reads are left
    out of the plan. Each level of dependency is a projection of plain columns: the optimizer keeps
    such a level apart where its values are used more than once."""
    c = F.col
    out = df.withColumn("p_given", text.given_address(c(appeal)))
    line, source = text.address_line(c("p_given"), c(location), c(title))
    out = out.withColumns({"p_line": line, "p_source": source})
    out = out.withColumn("p_address", text.collapse(c("p_line")))
    out = out.withColumn("p_region", text.region(c("p_address")))
    out = out.withColumn("p_way", text.street(c("p_address"), c("p_region")))
    out = out.withColumn("p_street", text.normal_street(c("p_way")))
    out = out.withColumn("p_scoped", text.without_place(c("p_address"), c("p_region"), c("p_street")))
    out = out.withColumns({f"p_match_{k}": v for k, v in text.component_matches(c("p_scoped")).items()})
    matches = {k: c(f"p_match_{k}") for k in text.PATTERNS}
    out = out.withColumns({f"p_{k}": v for k, v in text.raw_components(matches).items()} | {"p_rest": text.rest_of(c("p_scoped"), matches)})
    return out.withColumn("p_organization", F.coalesce(text.organization_in(c(title)), text.organization_in(c(appeal))))


def parse_complaint(df: DataFrame, *, title: str = "title", appeal: str = "appeal_text", location: str = "location", into: str = "parsed") -> DataFrame:
    """Adds the whole parse of a complaint as one struct column: address and its components,
    title, organisation, earlier order ids and issue segments."""
    c = F.col
    out = with_parse(df, title=title, appeal=appeal, location=location)
    there = c("p_street").isNotNull()
    sure = F.when((c("p_source") == "appeal_address") & there, 0.95).when(there, 0.75).otherwise(0.4)
    parsed = F.struct(
        c("p_region").alias("region"),
        c("p_street").alias("street"),
        *((text.numbered_component(c(f"p_{k}")) if k in ("building", "floor") else c(f"p_{k}")).alias(k) for k in text.COMPONENTS),
        text.none_if_empty(c("p_rest")).alias("anchor_raw"),
        text.anchor_type(c("p_rest")).alias("anchor_type"),
        text.first_contained(c("p_rest"), rules.DIRECTIONS).alias("direction"),
        c("p_address").alias("address_raw"),
        c("p_line").alias("address_line"),
        c("p_source").alias("parse_source"),
        sure.alias("parse_confidence"),
        text.clean_title(c(title)).alias("normalized_title"),
        F.coalesce(c("p_organization"), text.organization_in(c("p_line"))).alias("organization_subject"),
        text.earlier_orders(c(appeal)).alias("previous_work_order_ids"),
        text.issue_segments(c(appeal)).alias("issue_segments"),
    )
    return out.withColumn(into, parsed).select(*df.columns, into)


def stamp(spark: SparkSession) -> str:
    """What a parse follows from besides the record: this code, Spark's version and the session's zone."""
    code = "".join(inspect.getsource(m) for m in (sys.modules[__name__], dates, keys, rules, text))
    return hashlib.sha256(f"{code}{spark.version}{spark.conf.get('spark.sql.session.timeZone')}{spark.conf.get('spark.sql.ansi.enabled')}".encode()).hexdigest()


def normalize(records: DataFrame, *, label_as_category: bool = True, families=rules.FAMILIES, beside: tuple[str, ...] = ()) -> DataFrame:
    """Records of schemas.RECORD as rows of schemas.PAYLOAD, and the columns `beside` as they are.

    `label_as_category` lets the numeral of the first issue segment stand in for a missing
    category, before the raw columns are looked at.
    """
    c, raw = F.col, F.col("raw_fields")
    out = records.withColumn("raw_fields", F.coalesce(raw, F.create_map().cast("map<string,string>")))
    out = out.withColumn("location", fallback(c("location"), raw_value(raw, "事发地点", "地址")))
    out = with_parse(out)
    out = out.withColumn("p_given_category", fallback(c("category"), c("category_level_4")))
    # Segments are cut only where no category is given.
    label = F.when(c("p_given_category").isNull(), text.first_label(c("appeal_text"))) if label_as_category else F.lit(None).cast("string")
    out = out.withColumn("p_label", label)
    out = out.withColumn("category", F.coalesce(c("p_given_category"), c("p_label"), raw_value(raw, "事项分类", "最终事项分类")))
    department = raw_value(raw, "所属部门", "部门")
    out = out.withColumns(
        {
            "record_key": keys.record_key(c("work_order_id"), {"title": c("title"), "appeal": c("appeal_text"), "location": c("location"), "category": c("category")}),
            "work_order_id": text.trim_to_null(c("work_order_id")),
            "department": department,
            "handled_by": F.coalesce(text.none_if_empty(c("processing_department")), raw_value(raw, "处理部门", "承办部门"), department),
            "street": F.coalesce(c("p_street"), F.lit(rules.UNKNOWN_STREET)),
            "anchor": F.coalesce(text.none_if_empty(c("p_rest")), F.lit(rules.UNKNOWN_ANCHOR)),
            "region": c("p_region"),
            "organization_subject": text.normal_organization(F.coalesce(c("p_organization"), text.organization_in(c("location")))),
            "issue_family": text.issue_family(c("title"), c("category"), c("appeal_text"), families=families),
        }
    )
    key = keys.event_key(c("region"), c("street"), c("anchor"), c("category"), c("organization_subject"), c("issue_family"), c("record_key"))
    kept = with_defaults(raw, {"受理时间": c("received_at"), "办结时间": c("completed_at"), "事发地点": c("location"), "处理部门": c("handled_by")})
    ended = F.coalesce(text.none_if_empty(c("completed_at")), raw_value(raw, "办结时间", "办结日期", "结案时间"))
    return out.select(
        "record_key",
        "work_order_id",
        parse_timestamp(c("received_at")).alias("received_at"),
        parse_timestamp(ended).alias("completed_at"),
        c("title").alias("title_raw"),
        text.clean_title(c("title")).alias("title_normalized"),
        "appeal_text",
        "category",
        c("handled_by").alias("processing_department"),
        "department",
        "location",
        "region",
        "street",
        "anchor",
        "organization_subject",
        "issue_family",
        key.alias("event_key"),
        kept.alias("raw_json"),
        "source_row",
        *beside,
    ).to(T.StructType([*PAYLOAD.fields, *(records.schema[k] for k in beside)]))
