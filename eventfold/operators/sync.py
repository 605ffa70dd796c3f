"""Full-snapshot sync: keep-last dedup, three-way diff, new state and version rows.

What happens to a key follows from digests of both sides' rows: only keys and digests are shuffled.
Where few keys change, the rows themselves are not: the corpus is passed over once, and the changed
keys go to its scan. Where many change, one full outer join of the rows decides.

An upload of the engine is mostly what the last one was. A row of the corpus keeps the digest of the
record that it was parsed from, so that equal records aren't parsed again, and the corpus after a sync
keeps what the sync changed, so that no row is written twice for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

IGNORED = ("created_at", "updated_at", "last_sync_id")
#: Changed keys that are broadcast, at most.
BROADCAST_KEYS = 200_000


def keep_last(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the order of `order`, which should be total. An aggregate,
    so that rows are reduced before the shuffle."""
    rest = [c for c in df.columns if c not in by]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*by).agg(last.alias("__last")).select(*by, *(F.col(f"__last.{c}").alias(c) for c in rest)).select(df.columns)


def keep_last_of_few(df: DataFrame, repeated: DataFrame, key: str, order: list[str]) -> DataFrame:
    """`keep_last` where few keys have more than one row, which `repeated` (key) has: only their rows
    are shuffled and sorted."""
    few = F.broadcast(repeated.select(key))
    return df.join(few, key, "left_anti").select(df.columns).unionByName(keep_last(df.join(few, key, "left_semi"), [key], order))


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Rows (key) of the keys with more than one row; nothing but keys is shuffled."""
    return df.groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1").select(key)


def comparable(c: Column, kind: T.DataType) -> Column:
    """A form that `<=>` can compare: maps as sorted entries."""
    return F.array_sort(F.map_entries(c)) if isinstance(kind, T.MapType) else c


def differs(before: str, after: str, schema: T.StructType, ignored: tuple[str, ...] = IGNORED) -> Column:
    out = F.lit(False)
    for field in schema.fields:
        if field.name not in ignored:
            out = out | ~comparable(F.col(f"{before}.{field.name}"), field.dataType).eqNullSafe(comparable(F.col(f"{after}.{field.name}"), field.dataType))
    return out


def digests(rows: DataFrame, columns: list[T.StructField], key: str, *more: Column) -> DataFrame:
    """Rows (key, more, __digest): 128 bits of the comparable fields, in the order of their names."""
    named = [f for f in sorted(columns, key=lambda f: f.name) if f.name not in (*IGNORED, key)]
    half = lambda k, f: F.when(F.col(f.name).isNull(), F.lit(0)).otherwise(F.xxhash64(F.lit(k), comparable(F.col(f.name), f.dataType)))
    return rows.select(key, *more, F.struct(*(F.xxhash64(F.lit(k), *(half(k, f) for f in named)).alias(f"d{k}") for k in (1, 2))).alias("__digest"))


def actions(upload: DataFrame, current: DataFrame, *, key: str = "record_key", missing: str = "missing_in_latest_upload") -> DataFrame:
    """Rows (key, action) of the keys that change, as `diff` has them. Keys and digests are joined,
    no other field leaves its task."""
    fields = [f for f in upload.schema.fields if f.name != missing]
    new = digests(upload, fields, key).select(key, F.col("__digest").alias("__new"))
    old = digests(current, fields, key, F.col(missing).alias("__gone")).select(key, "__gone", F.col("__digest").alias("__old"))
    joined = new.join(old, key, "full_outer")
    gone = F.when(~F.col("__gone"), "missing")
    action = F.when(F.col("__old").isNull(), "inserted").when(F.col("__new").isNull(), gone).when((F.col("__new") != F.col("__old")) | F.col("__gone"), "updated")
    return joined.select(key, action.alias("action")).where("action is not null")


def changes_of(upload: DataFrame, current: DataFrame, changed: DataFrame, *, key: str = "record_key", missing: str = "missing_in_latest_upload") -> DataFrame:
    """The rows of `diff` for these few changed keys, which go to the scans of both sides."""
    few = F.broadcast(changed.select(key))
    return diff(upload.join(few, key, "left_semi"), current.join(few, key, "left_semi"), key=key, missing=missing)


def carried(current: DataFrame, changed: DataFrame, *, sync_id: str, key: str = "record_key", missing: str = "missing_in_latest_upload") -> DataFrame:
    """The corpus's rows of all other keys after the sync: those that the upload has get its id. One
    that was missing and is still so isn't in the upload."""
    kept = current.join(F.broadcast(changed.select(key)), key, "left_anti")
    return kept.withColumn("last_sync_id", F.when(F.col(missing), F.col("last_sync_id")).otherwise(F.lit(sync_id)))


def diff(upload: DataFrame, current: DataFrame, *, key: str = "record_key", missing: str = "missing_in_latest_upload") -> DataFrame:
    """Rows (key, action, before, after) of the union of keys. `upload` has one row a key and
    `current` the same columns and the missing flag. Actions are inserted, updated (any field
    differs, or the row was missing), missing (newly), and unchanged."""
    flagged = upload.withColumn(missing, F.lit(False))
    columns = [c for c in flagged.columns if c != key]
    left = flagged.select(F.col(key), F.struct(*columns).alias("after"))
    kept = [c for c in current.columns if c != key]
    right = current.select(F.col(key), F.struct(*kept).alias("before"))
    schema = T.StructType([f for f in flagged.schema.fields if f.name != key])
    action = (
        F.when(F.col("before").isNull(), "inserted")
        .when(F.col("after").isNull(), F.when(F.col(f"before.{missing}"), "unchanged").otherwise("missing"))
        .when(differs("before", "after", schema), "updated")
        .otherwise("unchanged")
    )
    return left.join(right, key, "full_outer").select(key, action.alias("action"), "before", "after")


def counts(changes: DataFrame) -> DataFrame:
    """One row: inserted, updated and missing rows."""
    return changes.agg(*(F.count_if(F.col("action") == a).alias(a) for a in ("inserted", "updated", "missing")))


def apply(changes: DataFrame, upload_schema: T.StructType, *, sync_id: str, now: Column, key: str = "record_key") -> DataFrame:
    """The corpus after the sync. Unchanged rows only get the sync's id, newly missing ones keep
    their fields, rows missing before are untouched."""
    action, b = F.col("action"), lambda c: F.col(f"before.{c}")
    fresh = action.isin("inserted", "updated")
    gone = F.col("after").isNull()
    fields = [F.when(fresh, F.col(f"after.{f.name}")).otherwise(b(f.name)).alias(f.name) for f in upload_schema.fields if f.name != key]
    return changes.select(
        key,
        *fields,
        F.when(action == "missing", True).when(gone, b("missing_in_latest_upload")).otherwise(False).alias("missing_in_latest_upload"),
        F.when(gone & (action == "unchanged"), b("last_sync_id")).otherwise(F.lit(sync_id)).alias("last_sync_id"),
        F.when(action == "inserted", now).otherwise(b("created_at")).alias("created_at"),
        F.when(action == "unchanged", b("updated_at")).otherwise(now).alias("updated_at"),
    )


def marked(records: DataFrame, fields: list[str], stamp: str) -> DataFrame:
    """Records with 128 bits of digest (record_d1, record_d2) of `fields` and of `stamp`: what their
    parse follows from. The text that is hashed tells null from empty and names every field."""
    text = F.to_json(F.struct(*fields))
    return records.select("*", *(F.xxhash64(F.lit(k), F.lit(stamp), text).alias(f"record_d{k}") for k in (1, 2)))


def told_apart(records: DataFrame, current: DataFrame, *, key: str = "record_key", missing: str = "missing_in_latest_upload") -> DataFrame:
    """Marked records with `__same`, the key of the current row that was parsed from an equal record,
    and whether that row was missing, `__gone`. Of such a record nothing but its place is kept."""
    known = current.where("record_d1 is not null").select("record_d1", "record_d2", F.col(key).alias("__same"), F.col(missing).alias("__gone"))
    found = records.join(known, ["record_d1", "record_d2"], "left")
    kept = lambda c: F.col(c) if c in ("source_row", "headers") else F.when(F.col("__same").isNull(), F.col(c)).alias(c)
    return found.select(*(kept(c) for c in records.columns), "__same", "__gone")


def merged(current: DataFrame, fresh: DataFrame, same: DataFrame, schema: T.StructType, *, sync_id: str, now: Column, key: str = "record_key", missing: str = "missing_in_latest_upload") -> DataFrame:
    """The corpus after an upload, with what became of each row (sync_action) and, where that is a
    change, the row before: `fresh` has the upload's newly parsed rows, `same` the keys of those that
    are as they were parsed before. Actions are as in `diff`, null for unchanged. Of `current` whole
    rows are joined, so that callers give what may change alone where that is little."""
    plain = [f for f in schema.fields if f.name != key]
    fields = [f.name for f in plain] + ["record_d1", "record_d2"]
    new = F.struct(*fields)
    rows = fresh.select(key, new.alias("after"), F.lit(False).alias("__same"))
    upload = rows.unionByName(same.select(key, F.lit(None).cast(rows.schema["after"].dataType).alias("after"), F.lit(True).alias("__same")))
    stored = [c for c in current.columns if c not in ("sync_action", "row_before")]
    old = current.select(key, F.struct(*stored).alias("before"))
    b, a = lambda c: F.col(f"before.{c}"), lambda c: F.col(f"after.{c}")
    there, was = F.col("__same").isNotNull(), F.coalesce(b(missing), F.lit(False))
    updated = F.when(was | (~F.col("__same") & differs("before", "after", T.StructType(plain))), "updated")
    action = F.when(F.col("before").isNull(), "inserted").when(~there, F.when(~was, "missing")).otherwise(updated)
    out = old.join(upload, key, "full_outer").select(key, "before", "after", "__same", action.alias("sync_action"))
    changed = F.col("sync_action").isNotNull()
    whole = F.struct(*(b(c).alias(c) for c in stored if c not in ("record_d1", "record_d2")))
    return out.select(
        key,
        *(F.when(F.col("after").isNotNull(), a(c)).otherwise(b(c)).alias(c) for c in fields),
        (~there).alias(missing),
        F.when(~there & was, b("last_sync_id")).otherwise(F.lit(sync_id)).alias("last_sync_id"),
        F.when(F.col("before").isNull(), now).otherwise(b("created_at")).alias("created_at"),
        F.when(changed, now).otherwise(b("updated_at")).alias("updated_at"),
        "sync_action",
        F.when(changed & F.col("before").isNotNull(), whole).alias("row_before"),
    )


def versions(logged: DataFrame, row: T.StructType, *, key: str = "record_key", missing: str = "missing_in_latest_upload") -> DataFrame:
    """A row for each change that states of the corpus have kept: before and after as whole rows
    (`row`), of missing rows the flag alone."""
    gone = F.col("sync_action") == "missing"
    state = ("last_sync_id", "created_at", "updated_at")
    at = lambda f: F.col(key) if f.name == key else F.lit(None).cast(f.dataType) if f.name in state else F.col(missing) if f.name == missing else F.when(~gone, F.col(f.name))
    after = F.struct(*(at(f).alias(f.name) for f in row.fields))
    return logged.where("sync_action is not null").select(F.col("last_sync_id").alias("sync_id"), key, F.col("sync_action").alias("action"), F.col("row_before").alias("before"), after.alias("after"), F.col("updated_at").alias("created_at"))


def absent(new: DataFrame, current: DataFrame, by: list[str]) -> DataFrame:
    """New rows whose key is not there yet, to be appended; there ones stay as they are."""
    return new.join(current.select(*by), by, "left_anti")
