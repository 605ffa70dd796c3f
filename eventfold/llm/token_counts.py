"""Token counts of documents in flat token files that have no index.

Files hold ids of fixed width and documents end with a separator id. Each block of a file
is searched for separators in one vectorised scan. Documents that begin in an earlier block
are stitched by a prefix scan over the blocks: the last separator before a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import local_fs, saved
from .token_ids import SegmentEncoder
from .token_store import _made, id_width, write_shards

#: Ids of a block.
BLOCK_IDS = 4_000_000
#: End of text in byte_bpe_50k: an id that no text yields, as its spelling is encoded as plain text.
END_OF_TEXT = 50256


def write_flat(docs: DataFrame, tokenizer_path: str, *, end_id: int = END_OF_TEXT, key: str = "doc_id", text: str = "text") -> tuple[str, DataFrame]:
    """Folder of flat files, one for each partition of `docs`, and the documents' order in them
    as rows (file, doc_no, key). Null and empty texts give the end id alone. Each row of `docs` is a
    document, rows that repeat and rows of equal or null key among them; a text of any length is one.
    An empty table gives no file and no rows. Other columns are not read, whatever their names. As
    files have no index, the spelling of a special token in a text is ordinary text here, and an end
    id that texts can yield is an error."""
    if SegmentEncoder(tokenizer_path, plain=True).yields(end_id):
        raise ValueError(f"id {end_id} stands for text in this vocabulary and can't end documents")
    spark = docs.sparkSession
    folder = _made(spark, "flat-tokens")
    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    width = id_width(tokenizer_path, end_id)
    entries = saved(write_shards(rows, folder, tokenizer_path, end_id, width, plain=True).select("shard", "key", "doc_no"), "order")
    names = F.format_string("shard-%06d.bin", F.col("shard"))
    order = entries.select(names.alias("file"), "doc_no", F.col("key").alias(key))
    return folder, order


def flat_files(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return sorted((f.getPath().getName(), f.getLen()) for f in found if f.getPath().getName().endswith(".bin"))


def count_tokens(spark: SparkSession, folder: str, *, separator: int = END_OF_TEXT, width: int = 2, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Rows (file, doc_no, start, n_tokens, closed) of every document in the folder's .bin files.

    `start` and `n_tokens` count ids within the file, the separator included; doc_no counts
    from 0. Ids after the last separator are a document with closed = false. Empty files and
    an empty folder give no rows; adjacent separators give documents of one id, equal documents a
    row each.
    """
    files = [(name, size // width) for name, size in flat_files(spark, folder)]
    blocks = spark.createDataFrame(files, "file string, ids long").where("ids > 0").select("file", "ids", F.explode(F.sequence(F.lit(0), ((F.col("ids") - 1) / block_ids).cast("long"))).alias("block"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = local_fs(folder)
        for b in batches:
            for name, ids, block in zip(*(b.column(k).to_pylist() for k in ("file", "ids", "block")), strict=True):
                with fs.open_input_file(f"{path}/{name}") as f:
                    f.seek(block * block_ids * width)
                    found = np.flatnonzero(np.frombuffer(f.read(block_ids * width), f"<u{width}") == separator) + block * block_ids
                # Positions of separators; the end of an open last document counts as one.
                closed = np.ones(len(found), bool)
                if (block + 1) * block_ids >= ids and (not len(found) or found[-1] != ids - 1):
                    found, closed = np.append(found, ids - 1), np.append(closed, False)
                n = len(found)
                before = np.concatenate(([-1], found[:-1])) if n else found
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.full(n, block, np.int64)), pa.array(np.arange(n, dtype=np.int64)), pa.array(found.astype(np.int64)), pa.array(before.astype(np.int64)), pa.array(closed)], ["file", "block", "nth", "at", "before", "closed"])

    dealt = blocks.repartition(max(1, min(10_000, sum(-(-n // block_ids) for _, n in files))), "file", "block")
    ends = saved(dealt.mapInArrow(scan, "file string, block long, nth long, at long, before long, closed boolean"), "separators")
    # Prefix scan: for each block the last separator, and the number of them, in the blocks before.
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = ends.groupBy("file", "block").agg(F.max("at").alias("last"), F.count("*").alias("n"))
    carry = sums.select("file", "block", F.coalesce(F.max("last").over(earlier), F.lit(-1)).alias("carried"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("docs_before"))
    start = F.when(F.col("nth") == 0, F.col("carried")).otherwise(F.col("before")) + 1
    return ends.join(carry, ["file", "block"]).select("file", (F.col("docs_before") + F.col("nth")).alias("doc_no"), start.alias("start"), (F.col("at") - start + 1).alias("n_tokens"), "closed")
