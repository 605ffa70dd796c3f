"""Target and reference sides by local calendar windows."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import ZONE, local_date

TIME_FIELDS = ("received_at", "completed_at")


class WindowOverlapError(ValueError):
    """Target and reference windows share a day."""


@dataclass(frozen=True)
class Windows:
    """Days, both ends inclusive; without a reference window everything else is reference."""

    time_field: str
    target_from: date
    target_to: date
    reference_from: date | None = None
    reference_to: date | None = None

    def __post_init__(self):
        if self.time_field not in TIME_FIELDS:
            raise ValueError(f"unknown time field {self.time_field!r}")
        if self.target_from > self.target_to:
            raise ValueError("the target window ends before it begins")
        if (self.reference_from is None) != (self.reference_to is None):
            raise ValueError("a reference window needs both ends")
        if self.manual:
            if self.reference_from > self.reference_to:
                raise ValueError("the reference window ends before it begins")
            if self.target_from <= self.reference_to and self.reference_from <= self.target_to:
                raise WindowOverlapError("target and reference windows overlap")

    @property
    def manual(self) -> bool:
        return self.reference_from is not None


def side_of(day: Column, w: Windows) -> Column:
    """'target', 'reference' or null (left out); a missing day counts as target."""
    inside = lambda a, b: day.between(F.lit(a), F.lit(b))
    other = F.when(inside(w.reference_from, w.reference_to), "reference") if w.manual else F.lit("reference")
    return F.when(day.isNull() | inside(w.target_from, w.target_to), "target").otherwise(other)


def assign_sides(rows: DataFrame, w: Windows, *, day: Column | None = None, zone: str = ZONE) -> DataFrame:
    """Live rows with their side; a manual reference window leaves out what lies in neither."""
    day = local_date(F.col(w.time_field), zone) if day is None else day
    return rows.withColumn("side", side_of(day, w)).where(F.col("side").isNotNull())


def side_counts(sided: DataFrame, time_field: str) -> DataFrame:
    """One row: rows of each side, and those without a time."""
    return sided.agg(
        F.count_if(F.col("side") == "target").alias("target_count"),
        F.count_if(F.col("side") == "reference").alias("reference_count"),
        F.count_if(F.col(time_field).isNull()).alias("missing_time_count"),
    )


def parse_day(value: str | None) -> date | None:
    return date.fromisoformat(value) if value else None


def parse_flag(value: str | None) -> bool:
    return (value or "").strip().lower() in ("1", "true", "yes", "on")


def from_text(latest: date | None, time_field: str, target_from: str = "", target_to: str = "", reference_from: str = "", reference_to: str = "") -> Windows:
    """Windows of a form's fields: without a start the latest day, without an end the start."""
    if latest is None:
        raise ValueError("no row has a date to compare by")
    start = parse_day(target_from) or latest
    return Windows(time_field, start, parse_day(target_to) or start, parse_day(reference_from), parse_day(reference_to))
