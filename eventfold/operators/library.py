"""The event library: filters, search, facets, sorting and pages over event summaries."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys, rules
from ..functions.dates import ZONE, local_date
from ..sources.store import Scratch
from .events import number, summarize

PAGE = 20
#: Fields of members, and of events beside their departments, that a keyword is looked for in.
SEARCHED = ("work_order_id", "title_raw", "appeal_text", "department", "processing_department")
NAMED = ("event_name", "issue_name", "region", "street_name")


@dataclass(frozen=True)
class EventFilters:
    region: str = ""
    street: str = ""
    processing_department: str = ""
    completed_from: date | None = None
    completed_to: date | None = None
    missing_completed: bool = False
    has_target_records: bool = False
    hide_singletons: bool = False
    keyword: str = ""
    search_all: bool = False


@dataclass(frozen=True)
class Layout:
    """How a table of members is read: issue name, local completion day, and searched columns."""

    issue: Column = field(default_factory=lambda: keys.issue_name(F.col("issue_family"), F.col("category")))
    completed_day: Column = field(default_factory=lambda: local_date(F.col("completed_at"), ZONE))
    searched: tuple[str, ...] = SEARCHED
    by: tuple[str, ...] = ("event_id", "event_name")
    #: Members that have no event id yet are grouped and numbered too; this names their events.
    name: Column | None = None


def summaries(members: DataFrame, filters: EventFilters | None = None, layout: Layout | None = None) -> DataFrame:
    """Summaries of the events that pass. What a filter needs of single members (a word, a day)
    is gathered in the one aggregation that makes the summaries; nothing is joined back."""
    f, at = filters or EventFilters(), layout or Layout()
    word = f.keyword.strip().lower()
    rows = members.withColumn("__day", at.completed_day)
    hit = F.lit(False)
    if word:
        for c in at.searched:
            hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(word)), F.lit(False))
    in_days = F.col("__day").isNotNull()
    if f.completed_from:
        in_days = in_days & (F.col("__day") >= F.lit(f.completed_from))
    if f.completed_to:
        in_days = in_days & (F.col("__day") <= F.lit(f.completed_to))
    wanted: list[Column] = []
    marks = {}
    if word:
        marks["__hit"] = F.bool_or(hit)
        named = ["event_name"] if at.name is not None or "event_name" in at.by else []
        own = [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(word)) for c in (*named, "issue_name", "region", "street_name")]
        listed = F.exists("processing_departments", lambda d: F.contains(F.lower(d), F.lit(word)))
        wanted.append(F.col("__hit") | listed | _any(own))
    if not f.search_all:
        if f.region.strip():
            wanted.append(F.col("region") == f.region.strip())
        if f.street.strip():
            wanted.append(F.col("street_name") == f.street.strip())
        if f.processing_department.strip():
            wanted.append(F.array_contains("processing_departments", f.processing_department.strip()))
        if f.has_target_records:
            wanted.append(F.col("target_count") > 0)
        if f.hide_singletons:
            wanted.append(F.col("member_count") > 1)
        if f.missing_completed:
            marks["__done"] = F.count("__day")
            wanted.append(F.col("__done") == 0)
        if f.completed_from or f.completed_to:
            marks["__within"] = F.bool_or(in_days)
            wanted.append(F.col("__within"))
    out = summarize(rows, list(at.by), at.issue, marks, at.name)
    for c in wanted:
        out = out.where(c)
    return out.drop(*marks)


def kept_summaries(members: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Summaries of all events with `completed_days`, the local days on which members ended: what
    every filter but a keyword asks for, so that none has to look at members again."""
    at = layout or Layout()
    days = F.array_sort(F.collect_set(at.completed_day))
    return summarize(members, list(at.by), at.issue, {"completed_days": days}, at.name)


def chosen(kept: DataFrame, filters: EventFilters | None = None, hits: DataFrame | None = None) -> DataFrame:
    """The kept summaries that pass; `hits` (event_id) are the events of the filters' keyword."""
    f, out = filters or EventFilters(), kept
    if hits is not None:
        out = out.join(hits, "event_id", "left_semi")
    if not f.search_all:
        for name, value in (("region", f.region), ("street_name", f.street)):
            if value.strip():
                out = out.where(F.col(name) == value.strip())
        if f.processing_department.strip():
            out = out.where(F.array_contains("processing_departments", f.processing_department.strip()))
        if f.has_target_records:
            out = out.where("target_count > 0")
        if f.hide_singletons:
            out = out.where("member_count > 1")
        if f.missing_completed:
            out = out.where(F.size("completed_days") == 0)
        if f.completed_from or f.completed_to:
            after = lambda d: d >= F.lit(f.completed_from) if f.completed_from else F.lit(True)
            before = lambda d: d <= F.lit(f.completed_to) if f.completed_to else F.lit(True)
            out = out.where(F.exists("completed_days", lambda d: after(d) & before(d)))
    return out.drop("completed_days")


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def singletons(found: DataFrame) -> DataFrame:
    return found.agg(F.count_if(F.col("member_count") == 1).alias("singleton_count"))


def facets(found: DataFrame, region: str = "", street: str = "") -> DataFrame:
    """One row: distinct regions, streets and departments, sorted, after both filters."""
    if region.strip():
        found = found.where(F.col("region") == region.strip())
    if street.strip():
        found = found.where(F.col("street_name") == street.strip())
    # A row a value, made distinct before any task gathers them.
    kinds = {"regions": F.array("region"), "streets": F.array("street_name"), "departments": F.col("processing_departments")}
    of = lambda kind: lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    each = F.concat(*(F.transform(c, of(kind)) for kind, c in kinds.items()))
    values = found.select(F.explode(each).alias("of")).select("of.*").where("value is not null").distinct()
    return values.agg(*(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("value")))).alias(kind) for kind in kinds))


def ordering(sort: str, event_id: str = "event_id") -> list[Column]:
    if sort == "member_count_desc":
        return [F.desc("member_count"), F.asc(event_id)]
    if sort == "member_count_asc":
        return [F.asc("member_count"), F.asc(event_id)]
    return [F.desc(event_id)]


def page(found: DataFrame, order: list[Column], limit: int = PAGE, offset: int = 0) -> DataFrame:
    """One page. Sort, offset and limit become one top-k, not a global sort."""
    return found.orderBy(*order).offset(max(0, offset)).limit(max(0, limit))


#: The orders that pages come in.
SORTS = ("updated_desc", "member_count_desc", "member_count_asc")


def placed(found: DataFrame, sort: str, owner: Scratch) -> DataFrame:
    """`found` with `__place`, each row's place from 1 in one of the orders, written in that order in
    small row groups: a page is a range of places, of which the scan reads a group or two, however
    far down it is."""
    by = [F.col("event_id")] if sort not in SORTS[1:] else [F.col("member_count"), F.col("event_id")]
    ranked = number(found, by, "__place", owner, (True,) if len(by) == 1 else (sort == "member_count_desc", False))
    path = owner.path("placed")
    ranked.repartitionByRange("__place").sortWithinPartitions("__place").write.option("parquet.block.size", 1 << 20).parquet(path)
    return found.sparkSession.read.schema(ranked.schema).parquet(path)


def page_at(rows: DataFrame, limit: int = PAGE, offset: int = 0) -> DataFrame:
    """A page of placed rows."""
    first, limit = max(0, offset), max(0, limit)
    return rows.where((F.col("__place") > first) & (F.col("__place") <= first + limit)).orderBy("__place").limit(limit).drop("__place")


def clamp(number: int, total: int, size: int = PAGE) -> tuple[int, int]:
    """The page number within what there is, and the number of pages."""
    pages = max(1, -(-total // size))
    return min(max(1, number), pages), pages


def page_count(found: DataFrame, number: int, size: int = PAGE) -> DataFrame:
    """One row: total, pages, and the page number within what there is, as `clamp` has them."""
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long")
    counted = found.agg(F.count("*").alias("total")).withColumn("pages", pages)
    return counted.withColumn("page", F.least(F.greatest(F.lit(1), F.lit(number)), "pages").cast("long"))


def latest_local_date(rows: DataFrame, time_field: str, *, live: Column | None = None, zone: str = ZONE) -> DataFrame:
    live = ~F.col("missing_in_latest_upload") if live is None else live
    return rows.where(live).agg(local_date(F.max(time_field), zone).alias("latest"))


def status_label(c: Column) -> Column:
    return F.coalesce(*(F.when(c == k, F.lit(v)) for k, v in rules.JOB_STATUS_LABELS.items()), F.lit(rules.UNKNOWN_STATUS))


def kind_label(c: Column) -> Column:
    return F.coalesce(*(F.when(c == k, F.lit(v)) for k, v in rules.JOB_KIND_LABELS.items()), F.lit(rules.OTHER_KIND))
