"""The engine: sync, compare, browse, review and export over a versioned store.

Methods that list things return DataFrames; those that change state write a new version.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import schemas
from .functions import keys, rules
from .functions.dates import local_start
from .jobs import Jobs
from .operators import events, keywords, library, normalize, review, sync, windows
from .operators.library import EventFilters
from .sources import files, xlsx_sink
from .sources.store import Scratch, Store


@dataclass(frozen=True)
class SyncResult:
    sync_id: str
    inserted: int
    updated: int
    missing: int


@dataclass(frozen=True)
class ComparisonResult:
    comparison_id: str
    target_count: int
    reference_count: int
    event_count: int
    singleton_count: int
    missing_time_count: int


class Settled:
    """What pages, searches and exports of a comparison read: members and summaries in the order of
    their events, and a keyword index, each written once, when first asked for. Later overrides touch few events; these are
    worked out anew from their own members and stand in for what was written."""

    def __init__(self, members: DataFrame, seq: int, overrides: list[str], base: list[str]):
        self.seq, self.overrides, self.base = seq, overrides, base
        self.scratch, self.later = Scratch(members.sparkSession), Scratch(members.sparkSession)
        self._given, self._written = members, None
        # Of the members a few fields are read here; sampling would work the summaries out again.
        found = self.scratch.staged(library.kept_summaries(members), "found")
        self._summaries = self.scratch.staged(found.repartitionByRange("event_id").sortWithinPartitions("event_id"), "summaries")
        self._index: DataFrame | None = None
        self._places: dict[str, DataFrame] = {}
        self.total = self._summaries.count()
        self.touched: list[int] = []
        self._anew: tuple[DataFrame, DataFrame] | None = None

    def _of(self, ids: list[int]):
        return F.col("event_id").isin(ids)

    @property
    def _members(self) -> DataFrame:
        """Whole members in their order. Pages and filters don't read them."""
        if self._written is None:
            self._written = self.scratch.staged(self._given.repartitionByRange("event_id").sortWithinPartitions("event_id", "record_key"), "members")
        return self._written

    @property
    def members(self) -> DataFrame:
        return self._members if self._anew is None else self._members.where(~self._of(self.touched)).unionByName(self._anew[0])

    @property
    def summaries(self) -> DataFrame:
        return self._summaries if self._anew is None else self._summaries.where(~self._of(self.touched)).unionByName(self._anew[1])

    def touch(self, ids: list[int], log: DataFrame, names: DataFrame, overrides: list[str]) -> None:
        """Works the events `ids` out anew: their members as first written, moved by `log`, under
        `names` (event_id, event_name)."""
        rows = review.moved(self._members.where(self._of(ids)), log).drop("event_name").join(F.broadcast(names), "event_id").select(self._members.columns)
        before, self.later = self.later, Scratch(rows.sparkSession)
        members = self.later.staged(rows.coalesce(1), "members")
        self._anew = members, self.later.staged(library.kept_summaries(members).coalesce(1), "summaries")
        self.touched, self.overrides = ids, overrides
        before.release()

    def page(self, sort: str, limit: int, offset: int) -> tuple[DataFrame, int]:
        """A page of all events and their number. As long as nothing was touched a page is a range
        of places; afterwards the first events of the order are found anew."""
        if self._anew is not None:
            found = self.summaries.drop("completed_days")
            return library.page(found, library.ordering(sort), limit, offset), found.count()
        if sort not in self._places:
            self._places[sort] = library.placed(self._summaries.drop("completed_days"), sort, self.scratch)
        return library.page_at(self._places[sort], limit, offset), self.total

    def find(self, word: str) -> DataFrame:
        """Rows (event_id) of the events that have the word. The index is of what was first written,
        so events touched since are looked through besides."""
        if self._index is None:
            self._index = self.scratch.staged(keywords.build(self._members, self._summaries), "keywords")
        old = keywords.hits(self._members, self._summaries, self._index, word)
        if self._anew is None:
            return old
        return old.where(~self._of(self.touched)).union(keywords.hits(*self._anew, None, word))

    def release(self) -> None:
        self.scratch.release()
        self.later.release()


class Engine:
    #: Comparisons that are kept at once, and events touched by overrides before one is written anew.
    KEPT, MOST_TOUCHED = 8, 500

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)
        self.jobs = Jobs(self.store)
        self._kept: dict[str, Settled] = {}

    def _read(self, table: str, version: int | None = None) -> DataFrame:
        return self.store.read(table, getattr(schemas, table.upper()), version)

    def _one(self, values: dict, table: str) -> DataFrame:
        schema = getattr(schemas, table.upper())
        return self.spark.createDataFrame([tuple(values.get(f) for f in schema.fieldNames())], schema).coalesce(1)

    # -- sync ---------------------------------------------------------------------------

    def sync_records(self, records: DataFrame, *, file_name: str, file_hash: str | None = None, headers: list[str] | None = None) -> SyncResult:
        """Makes `records` (schemas.RECORD) the corpus: later rows of a key replace earlier
        ones, rows that differ are updated, rows not there are flagged. No records: ValueError.
        The run is on record as failed if anything goes wrong, another sync in between included;
        nothing else changes then."""
        sync_id, started, base = uuid.uuid4().hex, datetime.now(UTC), self.store.version()
        run = {"id": sync_id, "file_name": file_name, "file_hash": file_hash, "created_at": started, "business_columns": headers}
        scratch: list[str] = []

        def held(label: str, df: DataFrame) -> DataFrame:
            scratch.append(self.store.stage(label, df))
            return self.spark.read.schema(df.schema).parquet(scratch[-1])

        try:
            if headers is None:
                records = records.withColumn("headers", F.map_keys("raw_fields"))
            marked, now = sync.marked(records, schemas.RECORD.fieldNames(), normalize.stamp(self.spark)), F.lit(started)
            digest = ("record_d1", "record_d2")
            if not self.store.manifest(base).get("work_orders"):
                # All that is there is parsed and written once, as the corpus.
                first = normalize.normalize(marked, beside=(*digest, *(["headers"] if headers is None else [])))
                state = {"missing_in_latest_upload": F.lit(False), "last_sync_id": F.lit(sync_id), "created_at": now, "updated_at": now, "sync_action": F.lit("inserted"), "row_before": F.lit(None).cast(schemas.WORK_ORDERS)}
                read = held("work_orders", first.withColumns(state))
                total = self._some(read)
                after = self._last_rows(read, held, "work_orders")
                kept = scratch[-1] if after is not read else scratch[0]
            else:
                current = self._logged("work_orders", base)
                # Of records that are as they were only the keys are read on.
                read = held("records", sync.told_apart(marked, current))
                total = self._some(read)
                fresh = held("payload", normalize.normalize(read.where("__same is null"), beside=digest))
                same = read.where("__same is not null").select(F.col("__same").alias("record_key"), "source_row", "__gone")
                fresh, same = self._last_of(fresh, same, held)
                n = same.agg(F.count("*").alias("all"), F.count_if("__gone").alias("gone")).first()
                merge = lambda old, same: sync.merged(old, fresh, same, schemas.PAYLOAD, sync_id=sync_id, now=now).to(schemas.LOGGED)
                if current.count() - n["all"] + n["gone"] <= sync.BROADCAST_KEYS:
                    # Of few changes only the rows are joined, and the rest of the corpus is passed over without a shuffle.
                    touched = held("changed", current.join(same.where(~F.col("__gone")), "record_key", "left_anti").select("record_key"))
                    few = F.broadcast(touched)
                    rows = merge(current.join(few, "record_key", "left_semi"), same.join(few, "record_key", "left_semi"))
                    rest = sync.carried(current, touched, sync_id=sync_id).withColumns({"sync_action": F.lit(None).cast("string"), "row_before": F.lit(None).cast(schemas.WORK_ORDERS)})
                    rows = rows.unionByName(rest.to(schemas.LOGGED))
                else:
                    rows = merge(current, same)
                after = held("work_orders", rows)
                kept = scratch[-1]
            if headers is None:
                # Headers in the order of the row that has most of them come first; one row a header.
                lists = read.select(F.col("headers").alias("k")).where(F.size("k") > 0).distinct().select("k", F.posexplode("k").alias("at", "header"))
                found = lists.groupBy("header").agg(F.min(F.struct(-F.size("k"), "k", "at")).alias("first")).orderBy("first").select("header").collect()
                run["business_columns"] = files.business_columns([[r["header"] for r in found]])
            if file_hash is None:
                # Rows that aren't missing are the upload's.
                rows = after.where(~F.col("missing_in_latest_upload")).select(F.sha2(F.to_json(F.struct(*[c for c in schemas.PAYLOAD.fieldNames() if c != "raw_json"])).cast("binary"), 256).alias("h"))
                # Order-free and of bounded size: sums of parts of the rows' hashes.
                parts = rows.agg(*(F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")) for k in range(4))).first()
                run["file_hash"] = hashlib.sha256(str(list(parts)).encode()).hexdigest()
            n = sync.counts(after.select(F.col("sync_action").alias("action"))).first()
            run |= {"status": "completed", "total_rows": total, "inserted_rows": n["inserted"], "updated_rows": n["updated"], "missing_rows": n["missing"], "completed_at": datetime.now(UTC)}
            # The state tells what the sync has changed, so it is the log of versions too.
            self.store.commit(replace={"work_orders": kept}, append={"changes": kept, "sync_runs": self.store.stage("sync_runs", self._one(run, "sync_runs"))}, base=base)
            scratch.remove(kept)
            return SyncResult(sync_id, n["inserted"], n["updated"], n["missing"])
        except Exception as e:
            failed = run | {"status": "failed", "error_message": str(e), "completed_at": datetime.now(UTC)}
            self.store.commit(append={"sync_runs": self.store.stage("sync_runs", self._one(failed, "sync_runs"))})
            raise
        finally:
            for path in scratch:
                self.store.remove(path)

    def _logged(self, table: str, version: int | None = None) -> DataFrame:
        return self.store.read(table, schemas.LOGGED, version)

    @staticmethod
    def _some(read: DataFrame) -> int:
        total = read.count()
        if not total:
            raise ValueError("no records to sync")
        return total

    def _last_rows(self, rows: DataFrame, held, label: str) -> DataFrame:
        """The last row of each key. Keys that repeat are few in an upload, and mostly none do; then
        no other row moves. Where many do, the rows are written anew, each key's last one."""
        repeated = held("repeated", sync.repeated_keys(rows, "record_key"))
        n = repeated.count()
        if not n:
            return rows
        last = sync.keep_last_of_few(rows, repeated, "record_key", ["source_row"]) if n <= sync.BROADCAST_KEYS else sync.keep_last(rows, ["record_key"], ["source_row"])
        return held(label, last)

    def _last_of(self, fresh: DataFrame, same: DataFrame, held) -> tuple[DataFrame, DataFrame]:
        """The same over newly parsed rows and the keys (record_key, source_row, __gone) of those that
        weren't parsed: of a key that both have, or either has repeatedly, the last row stays."""
        keys_of = lambda df, new: df.select("record_key", "source_row", F.lit(new).alias("new"))
        both = keys_of(fresh, True).unionByName(keys_of(same, False))
        last = both.groupBy("record_key").agg(F.count("*").alias("n"), F.max(F.struct("source_row", "new")).alias("last")).where("n > 1")
        repeated = held("repeated", last.select("record_key", F.col("last.new").alias("new")))
        if not repeated.count():
            return fresh, same
        fresh = self._last_rows(held("payload", fresh.join(repeated.where("not new"), "record_key", "left_anti")), held, "payload")
        same = same.join(repeated.where("new"), "record_key", "left_anti").select("record_key", "__gone").distinct()
        return fresh, held("same", same)

    def sync_file(self, path: str, *, max_rows: int | None = files.MAX_ROWS) -> SyncResult:
        """Keeps a copy of the file under the store's uploads, and syncs that."""
        kept, digest = files.land(self.spark, path, f"{self.store.root}/uploads")
        with Scratch(self.spark) as owner:
            records = files.load_records(self.spark, kept, max_rows=max_rows, owner=owner)
            return self.sync_records(records, file_name=str(path).rsplit("/", 1)[-1], file_hash=digest)

    def list_current_orders(self) -> DataFrame:
        return self._read("work_orders").orderBy("record_key")

    def count_current_orders(self) -> int:
        return self._read("work_orders").count()

    def latest_local_date(self, time_field: str) -> date | None:
        return library.latest_local_date(self._read("work_orders"), time_field).first()["latest"]

    def version_count(self, sync_id: str) -> int:
        return self.versions().where(F.col("sync_id") == sync_id).count()

    def versions(self) -> DataFrame:
        """Every change of every sync, with the row before and after; stores of old have a table of them."""
        found = sync.versions(self._logged("changes"), schemas.WORK_ORDERS).to(schemas.VERSIONS)
        return self._read("versions").unionByName(found) if self.store.manifest().get("versions") else found

    def sync_history(self) -> DataFrame:
        """Completed and failed syncs, `nth` 1 for the latest, with the number of versions of each."""
        counted = self.versions().groupBy(F.col("sync_id").alias("id")).agg(F.count("*").alias("n_versions"))
        runs = self._read("sync_runs").withColumn("nth", F.row_number().over(Window.orderBy(F.desc("created_at"), "id")))  # a row an upload
        return runs.join(counted, "id", "left").withColumn("n_versions", F.coalesce("n_versions", F.lit(0)))

    def list_sync_runs(self, *, limit: int | None = None, offset: int = 0) -> DataFrame:
        return self._listed("sync_runs", limit, offset)

    def _listed(self, table: str, limit: int | None, offset: int) -> DataFrame:
        out = self._read(table).orderBy(F.desc("created_at"), "id").offset(offset)
        return out if limit is None else out.limit(limit)

    # -- comparisons --------------------------------------------------------------------

    def compare(self, *, time_field: str = "received_at", target_from: date, target_to: date, reference_from: date | None = None, reference_to: date | None = None, forbidden: DataFrame | None = None) -> ComparisonResult:
        """Splits the live corpus into sides, groups it into events and stores all of it as one
        immutable comparison. `forbidden` pairs (left, right) of record keys never share an event."""
        w = windows.Windows(time_field, target_from, target_to, reference_from, reference_to)
        last = self._read("sync_runs").where("status = 'completed'").orderBy(F.desc("created_at")).limit(1).collect()
        if not last:
            raise ValueError("nothing has been synced yet")
        comparison_id, now, base = uuid.uuid4().hex, datetime.now(UTC), self.store.version()
        rows = windows.assign_sides(self._read("work_orders").where(~F.col("missing_in_latest_upload")), w)
        if forbidden is not None:
            rows = events.split_conflicts(rows, forbidden)
        c = F.col
        name = keys.event_name(c("region"), c("street"), c("organization_subject"), c("anchor"), c("title_raw"), c("event_key"), keys.issue_name(c("issue_family"), c("category")))
        grouped = events.group_events(rows, name)
        # Ids go on from those of all comparisons before.
        event_id = (F.col("event_id") + self._last_event(base)).alias("event_id")
        found = grouped.select(F.lit(comparison_id).alias("comparison_id"), event_id, "event_key", "event_name", F.lit("active").alias("status"), F.lit(now).alias("created_at")).to(schemas.EVENTS)
        at_events = self.store.stage("events", found)
        found = self.spark.read.schema(schemas.EVENTS).parquet(at_events)
        snapshot = F.struct(*(F.col(f) for f in schemas.WORK_ORDERS.fieldNames())).alias("snapshot")
        members = rows.select("record_key", "side", "event_key", snapshot).join(found.select("event_id", "event_key"), "event_key").withColumn("comparison_id", F.lit(comparison_id))
        at_members = self.store.stage("members", members.select(*schemas.MEMBERS.fieldNames()).to(schemas.MEMBERS))
        members = self.spark.read.schema(schemas.MEMBERS).parquet(at_members)
        sides = windows.side_counts(members.select("side", F.col(f"snapshot.{time_field}").alias(time_field)), time_field).first()
        total = events.event_counts(members.groupBy("event_id").agg(F.count("*").alias("member_count"))).first()
        end = lambda d: None if d is None else F.date_add(F.lit(d), 1)
        bounds = {"target_from": F.lit(target_from), "target_to": end(target_to), "reference_from": F.lit(reference_from) if reference_from else None, "reference_to": end(reference_to)}
        utc = self.spark.range(1).select(*((F.lit(None).cast("timestamp") if v is None else local_start(v)).alias(k) for k, v in bounds.items())).first().asDict()
        result = ComparisonResult(comparison_id, sides["target_count"], sides["reference_count"], total["event_count"], total["singleton_count"], sides["missing_time_count"])
        counts = {k: getattr(result, k) for k in ("target_count", "reference_count", "event_count", "singleton_count", "missing_time_count")}
        run = {"id": comparison_id, "sync_id": last[0]["id"], "time_field": time_field, "reference_mode": "manual" if w.manual else "complement", "status": "completed", "created_at": now} | utc | counts
        self.store.commit(append={"events": at_events, "members": at_members, "comparison_runs": self.store.stage("comparison_runs", self._one(run, "comparison_runs"))}, base=base)
        return result

    def list_comparisons(self, *, limit: int | None = None, offset: int = 0) -> DataFrame:
        return self._listed("comparison_runs", limit, offset)

    def comparison_headers(self) -> DataFrame:
        """Comparisons, `nth` 1 for the latest, with the headers of the sync each stands on."""
        runs = self._read("comparison_runs").withColumn("nth", F.row_number().over(Window.orderBy(F.desc("created_at"), "id")))  # a row a comparison
        return runs.join(self._read("sync_runs").select(F.col("id").alias("sync_id"), F.col("business_columns").alias("headers")), "sync_id", "left")

    def event_owners(self) -> DataFrame:
        """Rows (event_id, comparison_id) of all events, made ones included."""
        made = self._read("overrides").where("kind = 'create'").select("event_id", "comparison_id")
        return self._read("events").select("event_id", "comparison_id").union(made)

    def count_comparisons(self) -> int:
        return self._read("comparison_runs").count()

    def get_comparison(self, comparison_id: str) -> dict | None:
        found = self._read("comparison_runs").where(F.col("id") == comparison_id).limit(1).collect()
        return found[0].asDict() if found else None

    def members(self, comparison_id: str) -> DataFrame:
        """Members after all moves, with their snapshots' fields, event names and status."""
        mine = F.col("comparison_id") == comparison_id
        log = self._read("overrides").where(mine)
        moved = review.moved(self._read("members").where(mine), log)
        named = self.list_comparison_events(comparison_id).select("event_id", "event_name")
        fields = [F.col(f"snapshot.{f}").alias(f) for f in schemas.WORK_ORDERS.fieldNames() if f not in ("record_key", "event_key")]
        return moved.select("comparison_id", "event_id", "record_key", "side", "event_key", *fields).join(named, "event_id")

    def list_comparison_events(self, comparison_id: str) -> DataFrame:
        mine = F.col("comparison_id") == comparison_id
        log = self._read("overrides").where(mine)
        found = review.renamed(self._read("events").where(mine).unionByName(self._made(log)), log)
        return review.archived(found, review.moved(self._read("members").where(mine), log))

    @staticmethod
    def _made(log: DataFrame) -> DataFrame:
        """Events that overrides have made."""
        return log.where("kind = 'create'").select("comparison_id", "event_id", F.concat(F.lit("manual|"), F.col("record_key")).alias("event_key"), F.col("name").alias("event_name"), F.lit("active").alias("status"), F.lit(None).cast("timestamp").alias("created_at"))

    def list_comparison_members(self, comparison_id: str) -> DataFrame:
        return self._read("members").where(F.col("comparison_id") == comparison_id).select("comparison_id", "record_key", "side", "event_key", F.col("snapshot.work_order_id").alias("work_order_id"), "snapshot")

    def event_member_snapshots(self, comparison_id: str, event_ids: list[int]) -> DataFrame:
        """Members of these events with their snapshots' fields; the scan skips other events' files."""
        return self._settled(comparison_id).members.where(F.col("event_id").isin(event_ids))

    def list_event_member_snapshots(self, comparison_id: str, event_id: int) -> DataFrame:
        return self.event_member_snapshots(comparison_id, [event_id]).orderBy("record_key")

    def _settled(self, comparison_id: str) -> Settled:
        """The comparison as written once, brought up to the overrides since."""
        found = self.store.manifest()
        base, log = [*found.get("members", []), *found.get("events", [])], found.get("overrides", [])
        kept = self._kept.get(comparison_id)
        if kept is not None and kept.base == base:
            if kept.overrides == log:
                return kept
            since = self._read("overrides").where((F.col("comparison_id") == comparison_id) & (F.col("seq") > kept.seq))
            touched = since.select(F.explode(F.array("event_id", "to_event")).alias("id")).where("id is not null").distinct().limit(self.MOST_TOUCHED + 1).collect()
            ids = sorted(r["id"] for r in touched)
            if len(ids) <= self.MOST_TOUCHED:
                kept.touch(ids, since, self._named(comparison_id, ids).select("event_id", "event_name"), log)
                return kept
        while len(self._kept) >= self.KEPT or comparison_id in self._kept:
            self._forget(comparison_id if comparison_id in self._kept else next(iter(self._kept)))
        seq = self._read("overrides").where(F.col("comparison_id") == comparison_id).agg(F.max("seq")).first()[0] or 0
        self._kept[comparison_id] = Settled(self.members(comparison_id), seq, log, base)
        return self._kept[comparison_id]

    def _forget(self, comparison_id: str) -> None:
        self._kept.pop(comparison_id).release()

    def release(self) -> None:
        """Removes what is kept of comparisons; the store itself stays."""
        for comparison_id in list(self._kept):
            self._forget(comparison_id)

    def _named(self, comparison_id: str, ids: list[int]) -> DataFrame:
        """These events under their last names, whether they have members or not."""
        mine = (F.col("comparison_id") == comparison_id) & F.col("event_id").isin(ids)
        log = self._read("overrides").where(mine)
        return review.renamed(self._read("events").where(mine).unionByName(self._made(log)), log)

    def event_summaries(self, comparison_id: str, filters: EventFilters | None = None) -> DataFrame:
        kept, word = self._settled(comparison_id), (filters or EventFilters()).keyword.strip().lower()
        return library.chosen(kept.summaries, filters, kept.find(word) if word else None)

    def list_event_summaries(self, comparison_id: str, *, filters: EventFilters | None = None, sort: str = "updated_desc", limit: int = 20, offset: int = 0) -> tuple[DataFrame, int]:
        if (filters or EventFilters()) == EventFilters():
            return self._settled(comparison_id).page(sort, limit, offset)
        found = self.event_summaries(comparison_id, filters)
        return library.page(found, library.ordering(sort), limit, offset), found.count()

    def count_singleton_events(self, comparison_id: str, *, filters: EventFilters | None = None) -> int:
        return library.singletons(self.event_summaries(comparison_id, filters)).first()[0]

    def event_filter_options(self, comparison_id: str, *, region: str = "", street: str = "") -> dict[str, list[str]]:
        return library.facets(self.event_summaries(comparison_id), region, street).first().asDict()

    def find_events(self, comparison_id: str, event_ids: list[int]) -> DataFrame:
        """Those of these events that there are, under their last names; without members they are
        archived. Only their own parts of events and summaries are read."""
        some = self._settled(comparison_id).summaries.where(F.col("event_id").isin(event_ids)).select("event_id", F.lit(True).alias("__some"))
        found = self._named(comparison_id, event_ids).join(F.broadcast(some), "event_id", "left")
        return found.withColumn("status", F.when(F.col("__some"), F.col("status")).otherwise("archived")).drop("__some").select(schemas.EVENTS.fieldNames())

    def get_event(self, comparison_id: str, event_id: int) -> dict | None:
        found = self.find_events(comparison_id, [event_id]).limit(1).collect()
        return found[0].asDict() if found else None

    def list_event_records(self, comparison_id: str, event_id: int, *, limit: int = 20, offset: int = 0) -> tuple[dict | None, DataFrame, int]:
        rows = self._settled(comparison_id).members.where(F.col("event_id") == event_id)
        return self.get_event(comparison_id, event_id), library.page(rows, [F.asc("record_key")], limit, offset), rows.count()

    # -- review and export --------------------------------------------------------------

    def _override(self, comparison_id: str, rows: list[dict], base: int) -> None:
        seq = (self._read("overrides", base).agg(F.max("seq")).first()[0] or 0) + 1
        values = [tuple(({"comparison_id": comparison_id, "seq": seq + i} | r).get(f) for f in schemas.OVERRIDES.fieldNames()) for i, r in enumerate(rows)]
        self.store.commit(append={"overrides": self.store.stage("overrides", self.spark.createDataFrame(values, schemas.OVERRIDES).coalesce(1))}, base=base)

    def comparison_of(self, event_id: int) -> str:
        """The comparison that an event belongs to; event ids are unique in the store."""
        of = F.col("event_id") == event_id
        found = self.event_owners().where(of).limit(1).collect()
        if not found:
            raise KeyError(event_id)
        return found[0]["comparison_id"]

    def _last_event(self, version: int | None = None) -> int:
        ids = self._read("events", version).select("event_id").union(self._read("overrides", version).where("kind = 'create'").select("event_id"))
        return ids.agg(F.max("event_id")).first()[0] or 0

    def update_event_name(self, event_id: int, name: str, *, comparison_id: str | None = None) -> None:
        """Renames an event; its comparison is looked up where none is given."""
        name, base = review.trimmed_name(name), self.store.version()
        comparison_id = comparison_id or self.comparison_of(event_id)
        if self._named(comparison_id, [event_id]).isEmpty():
            raise KeyError(event_id)
        self._override(comparison_id, [{"kind": "rename", "event_id": event_id, "name": name}], base)

    def exclude_event_member(self, comparison_id: str, event_id: int, record_key: str, *, target_name: str = "") -> int:
        """Moves a record to the active event of the given name, or to a new one; its id."""
        base = self.store.version()
        kept = self._settled(comparison_id)
        if kept.members.where((F.col("event_id") == event_id) & (F.col("record_key") == record_key)).isEmpty():
            raise KeyError((event_id, record_key))
        # Events with members are the active ones.
        match = [] if not target_name.strip() else kept.summaries.where(review.has_name(target_name) & (F.col("event_id") != event_id)).orderBy("event_id").limit(1).collect()
        if match:
            to, made = match[0]["event_id"], []
        else:
            to = self._last_event(base) + 1
            made = [{"kind": "create", "event_id": to, "record_key": uuid.uuid4().hex, "name": review.exclusion_name(target_name)}]
        self._override(comparison_id, [*made, {"kind": "move", "event_id": event_id, "record_key": record_key, "to_event": to}], base)
        return to

    def export_rows(self, comparison_id: str, *, filters: EventFilters | None = None) -> DataFrame:
        return review.export_rows(self._settled(comparison_id).members, self.event_summaries(comparison_id, filters))

    def sync_business_columns(self, comparison_id: str) -> list[str]:
        run = self.get_comparison(comparison_id)
        found = self._read("sync_runs").where(F.col("id") == run["sync_id"]).limit(1).collect() if run else []
        return list(found[0]["business_columns"] or []) if found else []

    def export_workbook(self, comparison_id: str, path: str, *, filters: EventFilters | None = None) -> str:
        """Two sheets, events of several records and lone ones, written by tasks (`xlsx_sink`); a full
        one goes on in further sheets."""
        headers = self.sync_business_columns(comparison_id) or list(rules.CANONICAL_HEADERS)
        rows = review.sheets(self.export_rows(comparison_id, filters=filters), headers)
        shown = list(rules.LEAD_HEADERS) + headers
        return xlsx_sink.write(path, {name: (shown, rows.where(F.col("sheet") == name)) for name in rules.SHEETS}, ["event_id", "record_key"], "band", spread=True)

    # -- jobs ---------------------------------------------------------------------------

    def create_job(self, kind: str, payload: dict) -> str:
        return self.jobs.create(kind, payload)

    def get_job(self, job_id: str) -> dict | None:
        return self.jobs.get(job_id)

    def list_jobs(self, *, limit: int = 20) -> DataFrame:
        return self.jobs.latest(limit)

    def claim_job(self) -> dict | None:
        return self.jobs.claim()

    def complete_job(self, job_id: str, result: dict) -> None:
        self.jobs.complete(job_id, result)

    def fail_job(self, job_id: str, message: str) -> None:
        self.jobs.fail(job_id, message)

    def work(self) -> dict | None:
        """Runs the next job, a sync of a file or a comparison of windows."""

        def compare(p: dict) -> dict:
            days = {k: date.fromisoformat(v) for k, v in p.items() if k != "time_field" and v}
            return self.compare(time_field=p.get("time_field", "received_at"), **days).__dict__

        return self.jobs.run_next({"sync": lambda p: self.sync_file(p["path"], max_rows=p.get("max_rows", files.MAX_ROWS)).__dict__, "compare": compare})
