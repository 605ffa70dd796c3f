"""Grouping rows into events and summing events up.

Members are ordered target first, then by record key; the first one names the event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import none_if_empty
from ..sources.store import Scratch, staged

ORDER = ("side_rank", "record_key")


def with_rank(members: DataFrame) -> DataFrame:
    return members.withColumn("side_rank", F.when(F.col("side") == "target", 0).otherwise(1))


def group_events(members: DataFrame, name: Column) -> DataFrame:
    """Rows (event_id, event_key, event_name, member_count, ...) of each event key.

    Ids number the events by their first members, over one row an event.
    """
    ranked = with_rank(members).withColumn("event_name", name)
    first = F.min_by(F.struct("event_name"), F.struct(*ORDER))
    grouped = ranked.groupBy("event_key").agg(F.min(F.struct(*ORDER)).alias("__first"), first.alias("__named"), F.count("*").alias("member_count"), F.count_if(F.col("side") == "target").alias("target_count"))
    return number(staged(grouped), [F.col("__first.side_rank"), F.col("__first.record_key")], "event_id").select("event_id", "event_key", F.col("__named.event_name").alias("event_name"), "member_count", "target_count")


def number(df: DataFrame, order: list[Column], into: str, owner: Scratch | None = None, descending: tuple[bool, ...] = ()) -> DataFrame:
    """Row numbers from 1 in the given order (ascending, unless told otherwise for each column),
    without one task that sees all rows.

    Rows are dealt by sampled ranges of the order and sorted within; the result is written, so
    that a row's range and place hold, and a range's first number follows from the sizes of the
    ranges before it, one row each on the driver. Sampling works the rows out once more, so that
    what is costly should be written before.
    """
    names = [f"__by{k}" for k in range(len(order))]
    by = [F.desc(n) if down else F.asc(n) for n, down in zip(names, descending or (False,) * len(order), strict=True)]
    keyed = df.select("*", *(c.alias(n) for c, n in zip(order, names, strict=True))).repartitionByRange(*by).sortWithinPartitions(*by).drop(*names)
    placed = staged(keyed.withColumn("__at", F.monotonically_increasing_id()), "numbered", owner)
    part = F.shiftright("__at", 33)
    done, firsts = 0, []
    for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        firsts.append((r["part"], done))
        done += r["n"]
    before = F.broadcast(df.sparkSession.createDataFrame(firsts, "__part long, __before long"))  # a row for each range
    out = placed.join(before, part == F.col("__part"))
    return out.withColumn(into, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__at", "__part", "__before")


def summarize(members: DataFrame, by: list[str], issue: Column, marks: dict[str, Column] | None = None, name: Column | None = None) -> DataFrame:
    """One row an event: counts, first and last reception, departments, and the first member's
    region, street and issue, and `marks`, further aggregates. It is one aggregation with partial
    results before the shuffle. With `name` events are numbered in the same pass: the first member
    gives the event its name and its place in the order of event_id."""
    ranked = with_rank(members).withColumn("__issue", issue)
    own = [] if name is None else [name.alias("event_name"), F.struct(*ORDER).alias("__order")]
    first = F.min_by(F.struct(*own, F.col("region").alias("region"), F.coalesce(none_if_empty(F.col("street")), F.lit(rules.UNKNOWN_STREET)).alias("street_name"), F.col("__issue").alias("issue_name")), F.struct(*ORDER))
    out = ranked.groupBy(*by).agg(
        first.alias("__first"),
        F.count("*").alias("member_count"),
        F.count_if(F.col("side") == "target").alias("target_count"),
        F.min("received_at").alias("first_received_at"),
        F.max("received_at").alias("last_received_at"),
        F.array_sort(F.collect_set(none_if_empty(F.col("processing_department")))).alias("processing_departments"),
        *(c.alias(k) for k, c in (marks or {}).items()),
    )
    out = out.select(*by, "__first.*", *[c for c in out.columns if c not in by and c != "__first"])
    return out if name is None else number(staged(out), [F.col(f"__order.{c}") for c in ORDER], "event_id").drop("__order")


def event_counts(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("event_count"), F.count_if(F.col("member_count") == 1).alias("singleton_count"))


def split_conflicts(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Members of a forbidden pair (left, right) within one event become events of their own;
    the others stay together. Two equi-joins on record keys, no pairs of members are made."""
    keyed = members.select("record_key", "event_key")
    both = pairs.join(keyed.select(F.col("record_key").alias("left"), F.col("event_key").alias("__l")), "left").join(keyed.select(F.col("record_key").alias("right"), F.col("event_key").alias("__r")), "right")
    hit = both.where(F.col("__l") == F.col("__r")).select(F.explode(F.array("left", "right")).alias("record_key")).distinct().withColumn("__split", F.lit(True))
    key = F.when(F.col("__split"), F.concat_ws("|", "event_key", F.lit("singleton"), "record_key")).otherwise(F.col("event_key"))
    return members.join(hit, "record_key", "left").withColumn("event_key", key).drop("__split").select(members.columns)
