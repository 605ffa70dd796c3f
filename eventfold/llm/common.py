"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import re
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import scratch, scratch_root


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session names none and runs in one process (a test) a local folder is set; on
    a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        there = spark.sparkContext._jsc.sc().getCheckpointDir()
        if there.isDefined():
            return there.get()
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = scratch_root(spark).rsplit("/", 1)[0]
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def shared_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in this application's part of the shared folder, all of which
    `sources.store.release` removes."""
    shared_dir(spark)
    return scratch(spark, label)


def saved(df: DataFrame, label: str = "step") -> DataFrame:
    """`df` written to the shared folder and read back, which cuts its lineage."""
    path = shared_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a path below the shared folder, in whatever store it is."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m"):
    """Rows go to Python in batches of about this size: whole texts fill the usual ten thousand rows
    with tens of megabytes, twice in each worker and again beside the executor's heap."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, size)
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


class Steps:
    """Tables written on the way to a result, each dropped once its readers are done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.made = spark, []

    def saved(self, df: DataFrame, label: str = "step") -> DataFrame:
        path = shared_path(self.spark, label)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.made.append((out, path))
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Removes these tables; others that aren't of this object's making are let be."""
        for df, path in self.made:
            if any(df is t for t in tables):
                drop_path(self.spark, path)
        self.made = [m for m in self.made if not any(m[0] is t for t in tables)]


def addressed(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` with a number for each row that is the same in every reading, and its column's name:
    a 64-bit hash of the row's file and place therein, so rows with equal ids or wholly equal
    ones are told apart. A frame that isn't a plain reading of files is written first."""
    name = "__row"
    while name in docs.columns:
        name += "_"
    plan = docs._jdf.queryExecution().analyzed()
    while (kind := plan.getClass().getSimpleName()) in ("Project", "Filter", "SubqueryAlias") and plan.children().size() == 1:
        plan = plan.children().head()
    if kind != "LogicalRelation" or "_metadata" in docs.columns:
        docs = saved(docs, "rows")
    return docs.select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias(name)), name


def by_class(rows: DataFrame, classes: DataFrame, by: list[str], total: int, copies: str = "copies") -> DataFrame:
    """Inner join of rows with their classes, which count their rows in `copies`. Classes with a
    thousandth of all `total` rows or more, of which there are a thousand at most, are broadcast,
    so that no task gets all rows of one; the others are joined by their key."""
    hot = F.broadcast(classes.where(F.col(copies) * 1000 >= total))
    cold = classes.where(F.col(copies) * 1000 < total)
    return rows.join(hot, by).unionByName(rows.join(hot.select(*by), by, "left_anti").join(cold, by))


def ranked(df: DataFrame, order: list[Column], into: str, steps: Steps) -> DataFrame:
    """`df`, a reading of files, with the place of each row from 1 in the given order. Rows equal
    in it are parted by their place in the files, so that many of them fill several ranges. Rows
    are dealt to sampled ranges, sorted there and written; a range's first place follows from the
    sizes of those before it, a row for each range on the driver."""
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    by = [*order, F.col("__tie")]
    placed = steps.saved(tied.repartitionByRange(*by).sortWithinPartitions(*by).drop("__tie").withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", 33)
    done, firsts = 0, []
    for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        firsts.append((r["part"], done))
        done += r["n"]
    before = F.broadcast(df.sparkSession.createDataFrame(firsts, "__part long, __before long"))
    out = placed.join(before, part == F.col("__part"))
    return out.withColumn(into, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__at", "__part", "__before")


def fold(key: str, n: int):
    """crc32 of an id's decimal text, modulo n; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def local_fs(uri: str):
    """pyarrow's file system and path for a URI; works in executors without a JVM gateway."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), os.path.abspath(uri)


def filtered(docs: DataFrame, text: str, judge) -> DataFrame:
    """Rows of `docs`, with all columns, for whose texts `judge` (a list of texts, to a boolean
    array) holds. Works through batches by the size of their texts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    from .sentencepiece_codec import by_size

    at = docs.columns.index(text)

    def run(batches):
        for whole in batches:
            # Positions ride along with the texts, so that all columns are cut alike.
            index = pa.RecordBatch.from_arrays([pa.array(range(whole.num_rows), pa.int64()), pc.cast(whole.column(at), pa.string())], ["row", "text"])
            for part in by_size(index, 1_000_000):
                keep = pa.array(judge(part.column(1).to_pylist()))
                yield whole.take(part.column(0).filter(keep))

    return docs.mapInArrow(run, docs.schema)
