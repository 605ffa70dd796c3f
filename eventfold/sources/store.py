"""Versioned tables in a folder: each write is a new version, a manifest names the current ones.

Parquet has no row updates, so an update computes a whole new version and swaps the manifest;
readers see all of a change or nothing of it.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


_LOCAL: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder of this application's scratch tables, below spark.checkpoint.dir, which driver and
    executors share. Only a session in one process may name no such folder; it gets a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = _LOCAL.setdefault(app, "file://" + tempfile.mkdtemp(prefix="eventfold-"))
    return f"{root.rstrip('/')}/eventfold-{app}"


def scratch(spark: SparkSession, label: str) -> str:
    """A new path for a scratch table."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def release(spark: SparkSession) -> None:
    """Removes all scratch tables of this application. Frames that were made before can't be read
    any more, unless they come from a store or from given files alone."""
    delete(spark, scratch_root(spark))


class Scratch:
    """Scratch tables with one owner, which removes them once what is read from them is done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def path(self, label: str) -> str:
        self.paths.append(scratch(self.spark, label))
        return self.paths[-1]

    def staged(self, df: DataFrame, label: str = "step") -> DataFrame:
        """`df` written and read back: what it holds is settled then."""
        path = self.path(label)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        for path in self.paths:
            delete(self.spark, path)
        self.paths = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.release()


def staged(df: DataFrame, label: str = "step", owner: Scratch | None = None) -> DataFrame:
    """`df` written to a scratch table of `owner`, or of the application, and read back."""
    return (owner or Scratch(df.sparkSession)).staged(df, label)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def version(self) -> int:
        """Number of the current version, 0 if there is none."""
        return max(self._numbers(), default=0)

    def manifest(self, version: int | None = None) -> dict[str, list[str]]:
        """Folders of each table's current version, or of the given one."""
        number = self.version() if version is None else version
        if not number:
            return {}
        stream = self._fs.open(self._path(f"{self.root}/manifest-{number:08d}.json"))
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def read(self, table: str, schema: T.StructType, version: int | None = None) -> DataFrame:
        found = self.manifest(version).get(table, [])
        # Known to be empty when planned, so that a join with it moves no row of the other side.
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema).limit(0)

    def stage(self, table: str, df: DataFrame) -> str:
        """Writes rows to a new folder that no manifest names yet."""
        path = f"{self.root}/{table}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def remove(self, path: str) -> None:
        """Removes a staged folder that no manifest names."""
        self._fs.delete(self._path(path), True)

    def commit(self, *, replace: dict[str, str] | None = None, append: dict[str, str] | None = None, base: int | None = None) -> int:
        """A new manifest with replaced and appended folders, and its version.

        A change that follows from what was read names the version it read, `base`; if another
        writer has committed since, that is a FileExistsError and nothing changes. Without it
        (appends that depend on nothing) the change is tried again on the newest version."""
        for _ in range(1 if base is not None else 50):
            version = self.version()
            if base is not None and version != base:
                break
            now = self.manifest(version)
            now |= {t: [p] for t, p in (replace or {}).items()}
            for t, p in (append or {}).items():
                now[t] = [*now.get(t, []), p]
            if self._put(version + 1, json.dumps(now, sort_keys=True)):
                return version + 1
        raise FileExistsError(f"another writer has committed after version {base if base is not None else version}")

    def _put(self, number: int, text: str) -> bool:
        """Writes a manifest under another name and moves it to its number, which fails if the
        number is taken; stores like HDFS decide that at once for all writers."""
        jvm = self.spark.sparkContext._jvm
        there = self._path(f"{self.root}/.{uuid.uuid4().hex}.part")
        out = self._fs.create(there, False)
        out.write(bytearray(text.encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(there, self._path(f"{self.root}/manifest-{number:08d}.json"), options)
            return True
        except Py4JJavaError as e:
            self._fs.delete(there, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
