"""Record keys, event keys and event names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .text import let, none_if_empty, or_empty, trim_to_null, without_blanks


def _json_text(c: Column) -> Column:
    return F.when(c.isNull(), "null").otherwise(F.regexp_replace(F.to_json(F.array(c)), r"(?s)^\[|\]$", ""))


def fingerprint(fields: dict[str, Column]) -> Column:
    """'fp:' and the SHA-256 of the fields as JSON with sorted names; nulls stay as null."""
    parts = []
    for i, name in enumerate(sorted(fields)):
        parts += [F.lit(f'{", " if i else "{"}"{name}": '), _json_text(fields[name])]
    return F.concat(F.lit("fp:"), F.sha2(F.concat(*parts, F.lit("}")).cast("binary"), 256))


def record_key(work_order_id: Column, fields: dict[str, Column]) -> Column:
    """'wo:' and the trimmed id, else the fingerprint of the record's raw text fields."""
    return F.coalesce(F.concat(F.lit("wo:"), trim_to_null(work_order_id)), fingerprint(fields))


def key_part(c: Column) -> Column:
    return let(F.lower(without_blanks(c.cast("string"))), lambda text: F.when(text != "", text).otherwise("-"))


def event_key(region: Column, street: Column, anchor: Column, category: Column, org: Column, family: Column, record: Column) -> Column:
    """Which records are one event: of one organisation and family at a place; alone if the
    family has no organisation or place or category are unknown; else of one place and category."""
    joined = lambda kind, *parts: F.concat_ws("|", F.lit(kind), *(key_part(p) for p in parts))
    has = lambda c: or_empty(c) != ""
    return (
        F.when(has(family) & has(org), joined("enterprise", region, street, org, family))
        .when(has(family) | (or_empty(anchor) == rules.UNKNOWN_ANCHOR) | ~has(category), joined("singleton", record))
        .otherwise(joined("ordinary", region, street, anchor, category))
    )


def issue_name(family: Column, category: Column, labels: dict[str, str] = rules.FAMILY_LABELS) -> Column:
    named = F.coalesce(*(F.when(family == k, F.lit(v)) for k, v in labels.items()), F.lit(None).cast("string"))
    return F.coalesce(named, none_if_empty(category), F.lit(rules.NO_CATEGORY))


def event_name(region: Column, street: Column, org: Column, anchor: Column, title: Column, key: Column, issue: Column) -> Column:
    subject = F.when(key.startswith("singleton|") & (or_empty(title) != ""), title).otherwise(F.coalesce(none_if_empty(org), none_if_empty(anchor)))
    return F.concat_ws("｜", *(F.coalesce(none_if_empty(c), F.lit(rules.UNKNOWN)) for c in (region, street, subject, issue)))
