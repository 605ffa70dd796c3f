"""Manual review as a log of overrides over immutable events, and export rows.

An override is a row of schemas.OVERRIDES: 'rename' gives an event a name, 'move' puts a
record into another event. The last one by `seq` holds. Nothing stored is rewritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import or_empty
from ..sources.store import staged
from .events import number


def latest(overrides: DataFrame, kind: str, by: list[str], value: str) -> DataFrame:
    return overrides.where(F.col("kind") == kind).groupBy(*by).agg(F.max_by(value, "seq").alias(value))


def moved(members: DataFrame, overrides: DataFrame) -> DataFrame:
    """Members with their event after all moves."""
    last = latest(overrides, "move", ["comparison_id", "record_key"], "to_event")
    return members.join(last, ["comparison_id", "record_key"], "left").withColumn("event_id", F.coalesce("to_event", "event_id")).drop("to_event").select(members.columns)


def renamed(events: DataFrame, overrides: DataFrame) -> DataFrame:
    last = latest(overrides, "rename", ["comparison_id", "event_id"], "name")
    return events.join(last, ["comparison_id", "event_id"], "left").withColumn("event_name", F.coalesce("name", "event_name")).drop("name").select(events.columns)


def archived(events: DataFrame, members: DataFrame) -> DataFrame:
    """Events with the status that their members give them: without any they are archived."""
    some = members.select("comparison_id", "event_id").distinct().withColumn("__some", F.lit(True))
    status = F.when(F.col("__some"), F.col("status")).otherwise("archived")
    return events.join(some, ["comparison_id", "event_id"], "left").withColumn("status", status).drop("__some").select(events.columns)


def safe_cell(c: Column) -> Column:
    """Text that a spreadsheet would take for a formula, made plain by a leading apostrophe."""
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def business_value(header: str, columns: list[str]) -> Column:
    """A header's raw value if the row's raw fields have the header (even empty), else the
    record's own field for it."""
    own = rules.CANONICAL_HEADERS.get(header)
    canonical = F.col(own).cast("string") if own in columns else F.lit(None).cast("string")
    return F.when(F.map_contains_key("raw_json", F.lit(header)), F.col("raw_json")[header]).otherwise(canonical)


def export_rows(members: DataFrame, chosen: DataFrame) -> DataFrame:
    """All members of the chosen events."""
    return members.join(chosen.select("event_id").distinct(), "event_id", "left_semi")


def sheets(rows: DataFrame, headers: list[str]) -> DataFrame:
    """Rows for the two sheets: sheet, band (colour index within the sheet), side and event
    name, then one safe cell for each header, in the order of event and record."""
    # Sheet and band are the event's: they follow from a row an event, and go to the members in one join.
    size = rows.groupBy("event_id").agg(F.count("*").alias("__size"))
    sized = staged(size.select("event_id", F.when(F.col("__size") > 1, rules.SHEETS[0]).otherwise(rules.SHEETS[1]).alias("sheet")))
    placed = number(sized, [F.col("sheet"), F.col("event_id")], "__nth")
    firsts = F.broadcast(placed.groupBy("sheet").agg(F.min("__nth").alias("__first")))  # two rows
    banded = placed.join(firsts, "sheet").select("event_id", "sheet", ((F.col("__nth") - F.col("__first")) % 2).cast("int").alias("band"))
    label = F.when(F.col("side") == "target", rules.SIDE_LABELS["target"]).otherwise(rules.SIDE_LABELS["reference"])
    cells = [safe_cell(business_value(h, rows.columns)).alias(h) for h in headers]
    return rows.join(banded, "event_id").select("sheet", "event_id", "record_key", "band", label.alias(rules.LEAD_HEADERS[0]), F.col("event_name").alias(rules.LEAD_HEADERS[1]), *cells)


def exclusion_name(name: str) -> str:
    return name.strip() or rules.LONE_EVENT


def trimmed_name(name: str) -> str:
    if not name.strip():
        raise ValueError("an event needs a name")
    return name.strip()


def has_name(name: str) -> Column:
    return or_empty(F.col("event_name")) == exclusion_name(name)
