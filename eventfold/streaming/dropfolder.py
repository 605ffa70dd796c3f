"""A drop folder as a stream: each new export (CSV, XLSX or XLS) is synced once, in order of arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine


def drop_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of new files, one file a batch."""
    return spark.readStream.format("binaryFile").option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.{csv,xlsx,xls}").schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("path", "modificationTime")


def sync_folder(engine: Engine, folder: str, checkpoint: str) -> StreamingQuery:
    """Syncs what is in the folder and ends; the checkpoint remembers what has been synced.

    A batch that is repeated after a failure syncs the same file again, which changes nothing.
    """

    def batch(df: DataFrame, _: int) -> None:
        for row in df.orderBy("modificationTime", "path").select(F.col("path")).collect():  # one file a batch
            engine.sync_file(row["path"])

    return drop_folder(engine.spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
