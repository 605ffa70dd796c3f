"""Job control: one active job at a time, first in first out, as rows of schemas.JOBS.

A control plane of a few rows: state lives in the store and each change is one new version that
follows the one it read. Where two writers claim a job at once, the second finds a newer version
and reads again, so only one of them gets it.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import functions as F

from .functions.rules import JOB_KIND_LABELS, OTHER_KIND
from .schemas import JOBS
from .sources.store import Store


#: Jobs that aren't finished.
ACTIVE = "status in ('queued', 'running')"


class ActiveJobConflictError(RuntimeError):
    def __init__(self, job: dict):
        self.job = job
        super().__init__(f"a job is active: {JOB_KIND_LABELS.get(job['kind'], OTHER_KIND)} ({job['id']})")


class Jobs:
    def __init__(self, store: Store):
        self.store = store

    def frame(self):
        return self.store.read("jobs", JOBS)

    def _changed(self, change):
        """change(rows) returns a result and whether rows changed; it is called again on newer
        rows if another writer came between. It sees the active jobs, of which there is one at most;
        finished ones stay as they are."""
        for _ in range(50):
            base = self.store.version()
            rows = [r.asDict() for r in self.store.read("jobs", JOBS, base).where(ACTIVE).orderBy("created_at", "id").collect()]
            result, changed = change(rows)
            if not changed:
                return result
            try:
                self._put(rows, base)
                return result
            except FileExistsError:
                continue
        raise FileExistsError("other writers keep changing the jobs")

    def _put(self, rows: list[dict], base: int) -> None:
        now = self.store.spark.createDataFrame([tuple(r[f] for f in JOBS.fieldNames()) for r in rows], JOBS)
        df = self.store.read("jobs", JOBS, base).where(f"not ({ACTIVE})").unionByName(now).coalesce(1)
        self.store.commit(replace={"jobs": self.store.stage("jobs", df)}, base=base)

    def create(self, kind: str, payload: dict) -> str:
        job = dict.fromkeys(JOBS.fieldNames()) | {"id": uuid.uuid4().hex, "kind": kind, "status": "queued", "payload": json.dumps(payload, ensure_ascii=False, sort_keys=True), "progress": 0, "created_at": datetime.now(UTC)}

        def change(rows: list[dict]):
            if rows:
                raise ActiveJobConflictError(rows[0])
            rows.append(job)
            return job["id"], True

        return self._changed(change)

    def get(self, job_id: str) -> dict | None:
        found = self.frame().where(F.col("id") == job_id).limit(1).collect()
        return found[0].asDict() if found else None

    def latest(self, limit: int = 20):
        return self.frame().orderBy(F.desc("created_at"), "id").limit(limit)

    def claim(self) -> dict | None:
        """The oldest queued job, now running; None if there is none."""

        def change(rows: list[dict]):
            job = next((r for r in rows if r["status"] == "queued"), None)
            if job:
                job |= {"status": "running", "started_at": datetime.now(UTC)}
            return job, job is not None

        return self._changed(change)

    def _finish(self, job_id: str, **values) -> None:
        def change(rows: list[dict]):
            job = next((r for r in rows if r["id"] == job_id), None)
            if job is None:
                raise KeyError(job_id)
            job |= {"completed_at": datetime.now(UTC)} | values
            return None, True

        self._changed(change)

    def complete(self, job_id: str, result: dict) -> None:
        self._finish(job_id, status="completed", progress=100, result_json=json.dumps(result, ensure_ascii=False, sort_keys=True))

    def fail(self, job_id: str, message: str) -> None:
        self._finish(job_id, status="failed", error_message=message)

    def run_next(self, handlers: dict) -> dict | None:
        """Claims and runs one job; its handler takes the payload and returns the result."""
        job = self.claim()
        if job is None:
            return None
        try:
            self.complete(job["id"], handlers[job["kind"]](json.loads(job["payload"])))
        except Exception as e:
            self.fail(job["id"], str(e))
        return self.get(job["id"])
