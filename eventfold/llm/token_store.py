"""Token ids in raw shards with a minimal perfect hash index, and flat files without one.

A store is a folder of
  shard-NNNNNN.bin  ids of consecutive documents, little-endian, nothing between them;
  index-NNNNNN.npz  one minimal perfect hash of about INDEX_KEYS keys: bit vectors of its
                    levels, then per slot a 32-bit fingerprint, shard, offset and number of ids;
  store.json        id width, index parts, and each shard's first position in the whole.
A key finds its document by one hash, one rank and one fingerprint comparison.
"""

from __future__ import annotations

import io
import json
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import local_fs, saved, shared_path
from .pieces import TOGETHER
from .sentencepiece_codec import by_size
from .token_ids import SegmentEncoder, worker_encoder

#: Keys in one part of the index, on average.
INDEX_KEYS = 100_000
#: Bits of a level for each key that is left; levels before the rest is kept in a sorted list.
BITS_A_KEY, LEVELS = 1.6, 48
#: Numbers of one key that are made together when it is read.
CHUNK = 4096


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """splitmix64 of 64-bit hashes and a salt."""
    z = h.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class MinimalPerfectHash:
    """Maps n distinct 64-bit hashes onto 0..n-1; other hashes map to any slot or to -1."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.ranks, self.bases, total = [], [], 0
        for bits in levels:
            self.ranks.append(np.cumsum(bits, dtype=np.int64) - bits)
            self.bases.append(total)
            total += int(bits.sum())
        self.placed = total

    @classmethod
    def build(cls, hashes: np.ndarray) -> MinimalPerfectHash:
        left, levels = hashes.astype(np.uint64), []
        while len(left) and len(levels) < LEVELS:
            size = max(64, math.ceil(BITS_A_KEY * len(left)))
            at = (_mixed(left, len(levels)) % np.uint64(size)).astype(np.int64)
            bits = np.bincount(at, minlength=size) == 1
            levels.append(bits)
            left = left[~bits[at]]
        return cls(levels, np.sort(left))

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        hashes = hashes.astype(np.uint64)
        out, open_ = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        for k, bits in enumerate(self.levels):
            at = (_mixed(hashes[open_], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = self.bases[k] + self.ranks[k][at[hit]]
            open_ = open_[~hit]
        if len(open_) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, hashes[open_]), len(self.rest) - 1)
            hit = self.rest[at] == hashes[open_]
            out[open_[hit]] = self.placed + at[hit]
        return out


def _fingerprints(hashes: np.ndarray) -> np.ndarray:
    return (_mixed(hashes, 1_000_003) >> np.uint64(32)).astype(np.uint32)


def _index_bytes(hashes: np.ndarray, columns: dict[str, np.ndarray]) -> bytes:
    found = MinimalPerfectHash.build(hashes)
    slots = found.slots(hashes)
    if len(np.unique(slots)) != len(slots) or (len(slots) and (slots.min() < 0 or slots.max() != len(slots) - 1)):
        raise ValueError("two keys of one index part have the same 64-bit hash")
    order = np.argsort(slots)
    out = io.BytesIO()
    np.savez(out, sizes=np.array([len(b) for b in found.levels], np.int64), bits=np.packbits(np.concatenate([*found.levels, np.zeros(0, bool)])), rest=found.rest, fingerprint=_fingerprints(hashes)[order], **{k: v[order] for k, v in columns.items()})
    return out.getvalue()


class IndexPart:
    """One index file in memory."""

    def __init__(self, data: bytes):
        with np.load(io.BytesIO(data)) as f:
            sizes, bits = f["sizes"], np.unpackbits(f["bits"])[: int(f["sizes"].sum())].astype(bool)
            self.hash = MinimalPerfectHash([x.copy() for x in np.split(bits, np.cumsum(sizes)[:-1])] if len(sizes) else [], f["rest"])
            self.fingerprint, self.shard, self.offset, self.n = (f[k] for k in ("fingerprint", "shard", "offset", "n"))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots, and whether the stored fingerprint is the key's."""
        slots = self.hash.slots(hashes)
        safe = np.maximum(slots, 0)
        return safe, (slots >= 0) & (self.fingerprint[safe] == _fingerprints(hashes)) if len(self.n) else np.zeros(len(hashes), bool)


def _put(folder: str, name: str, chunks: Iterator[bytes]) -> None:
    """Writes a file under another name first: a repeated or lost task leaves none half written."""
    fs, path = local_fs(folder)
    there = f"{path}/{name}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(there) as out:
        for c in chunks:
            out.write(c)
    fs.move(there, f"{path}/{name}")


def _get(folder: str, name: str) -> bytes:
    fs, path = local_fs(folder)
    with fs.open_input_stream(f"{path}/{name}") as f:
        return f.read()


def _made(spark: SparkSession, label: str) -> str:
    folder = shared_path(spark, label)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    return folder


def id_width(tokenizer_path: str, end_id: int | None) -> int:
    return 2 if max(SegmentEncoder(tokenizer_path).size - 1, end_id or 0) < 2**16 else 4


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None, width: int, *, plain: bool = False) -> DataFrame:
    """Writes one shard for each partition of `docs` (key, text); a row (shard, key, nth, doc_no,
    at, n) for each document, in order: nth counts equal keys that follow each other in the
    shard, doc_no all documents of the shard. `plain` takes special tokens for ordinary text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encoder, at, last, nth, done = TaskContext.get().partitionId(), None, 0, object(), 0, 0
        fs, path = local_fs(folder)
        name = f"{path}/shard-{shard:06d}.bin"
        there, out = f"{name}.{uuid.uuid4().hex}.part", None
        for whole in batches:
            encoder = encoder or worker_encoder(tokenizer_path, plain)
            for batch in by_size(whole, TOGETHER):
                out = out or fs.open_output_stream(there)
                ids, n = encoder.encode(batch.column(1), end_id)
                out.write(ids.astype(f"<u{width}").tobytes())
                times = []
                for key in batch.column(0).to_pylist():
                    nth = nth + 1 if key == last else 0
                    last = key
                    times.append(nth)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), shard, np.int32)), batch.column(0), pa.array(times, pa.int64()), pa.array(done + np.arange(len(n), dtype=np.int64)), pa.array(at + np.cumsum(n) - n), pa.array(n)], schema.names)
                at += int(n.sum())
                done += len(n)
        if out:
            out.close()
            fs.move(there, name)

    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("key", docs.schema["key"].dataType), *T.StructType.fromDDL("nth long, doc_no long, at long, n long").fields])
    return docs.select("key", "text").mapInArrow(run, schema)


def write_store(docs: DataFrame, tokenizer_path: str, *, end_id: int | None = 0, key: str = "doc_id", text: str = "text") -> str:
    """Writes all rows of `docs` in ascending key order as a store; its folder, below the
    folder that the executors share.

    Whole texts are encoded as the library does by default, without added special tokens (the
    spelling of one in a text is that token), and closed by `end_id` (None: not closed); null
    and empty texts give the end id alone. Null keys come first. Rows with equal keys are all
    kept, in the order of their texts' hashes, and are told apart by their number; equal rows are
    dealt over shards too. An empty table gives a store without shards. Other columns are not read.
    """
    spark = docs.sparkSession
    folder, width = _made(spark, "token-store"), id_width(tokenizer_path, end_id)
    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.withColumn("spread", F.monotonically_increasing_id()).repartitionByRange("key", "tie", "spread").sortWithinPartitions("key", "tie")
    entries = saved(write_shards(ordered, folder, tokenizer_path, end_id, width).drop("doc_no"), "entries")
    # One row for each shard: where it starts, and equal keys that run on from the shards before.
    ends = entries.groupBy("shard").agg(F.sum("n").alias("n"), F.count("*").alias("docs"), F.min(F.struct("at", "key")).key.alias("first"), F.max(F.struct("at", "key")).key.alias("last"), F.max(F.struct("at", "nth")).nth.alias("last_nth"))
    base, before, run_on, shards = 0, None, 0, []
    for s in ends.orderBy("shard").collect():  # bounded: a row for each shard file
        carried = run_on if before is not None and before == (s["first"],) else 0
        shards.append({"shard": s["shard"], "base": base, "docs": s["docs"], "carried": carried})
        base += s["n"]
        run_on = s["last_nth"] + 1 + (carried if s["last"] == s["first"] else 0)
        before = (s["last"],)
    total = sum(s["docs"] for s in shards)
    parts = max(1, math.ceil(total / INDEX_KEYS))
    carried = {s["shard"]: s["carried"] for s in shards if s["carried"]}
    if carried:
        table = spark.createDataFrame([(k, v) for k, v in carried.items()], "shard int, carried long")
        firsts = entries.where("at = 0").select("shard", F.struct("key").alias("first"))
        entries = entries.join(table.join(firsts, "shard"), "shard", "left").withColumn("nth", F.col("nth") + F.when(F.struct("key").eqNullSafe(F.col("first")), F.coalesce("carried", F.lit(0))).otherwise(0))
    hashed = entries.select(*_hashed(parts), "shard", "at", "n")

    def index(part: pa.Table) -> pa.Table:
        number = part.column("part")[0].as_py()
        column = lambda name: part.column(name).to_numpy()
        _put(folder, f"index-{number:06d}.npz", iter([_index_bytes(column("h").astype(np.uint64), {"shard": column("shard"), "offset": column("at"), "n": column("n")})]))
        return pa.table({"part": pa.array([number], pa.int32()), "keys": pa.array([part.num_rows], pa.int64())})

    built = hashed.groupBy("part").applyInArrow(index, "part int, keys long").agg(F.sum("keys").alias("keys")).first()
    if (built["keys"] or 0) != total:
        raise RuntimeError(f"the index holds {built['keys']} of {total} documents")
    _put_text(spark, f"{folder}/store.json", json.dumps({"width": width, "parts": parts, "documents": total, "ids": base, "shards": [[s["shard"], s["base"]] for s in shards]}))
    return folder


def _put_text(spark: SparkSession, path: str, text: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def _hashed(parts: int):
    h = F.xxhash64("key", "nth")
    return [F.pmod(F.shiftright(h, 7), F.lit(parts)).cast("int").alias("part"), h.alias("h")]


def store_info(folder: str) -> dict:
    return json.loads(_get(folder, "store.json"))


def read_store(keys: DataFrame, folder: str, *, key: str = "doc_id", payload: bool = True) -> DataFrame:
    """Rows (key, nth, start, n_tokens, ids binary) of the wanted keys, read from the store.

    A key that occurs k times in `keys` gets its first k documents. `ids` holds little-endian
    unsigned 32-bit integers, null without `payload`; `start` counts the ids of all documents
    before. Keys that the store doesn't hold give no row (up to a false fingerprint in 2**32).
    """
    info = store_info(folder)
    width, bases = info["width"], dict(map(tuple, info["shards"]))
    # Keys are counted before they are dealt, and their numbers made in two steps of chunks.
    chunks = keys.groupBy(keys[key].alias("key")).agg(F.count("*").alias("times")).select("key", "times", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / CHUNK))).alias("chunk"))
    first = F.col("chunk") * CHUNK
    wanted = chunks.select("key", F.explode(F.sequence(first, F.least(first + CHUNK, F.col("times")) - 1)).alias("nth"))
    wanted = wanted.select("key", "nth", *_hashed(info["parts"]))
    field = T.StructField("key", wanted.schema["key"].dataType)
    placed_type = T.StructType([field, *T.StructType.fromDDL("nth long, shard int, at long, n long").fields])
    parts = info["parts"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, IndexPart] = {}
        for b in batches:
            part, h = b.column("part").to_numpy(), b.column("h").to_numpy().astype(np.uint64)
            for number in np.unique(part).tolist():
                if number not in held:
                    if len(held) >= 8:
                        held.clear()
                    held[number] = IndexPart(_get(folder, f"index-{number:06d}.npz"))
                rows = np.flatnonzero(part == number)
                slots, there = held[number].find(h[rows])
                rows, slots = rows[there], slots[there]
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([b.column("key").take(at), b.column("nth").take(at), *(pa.array(c[slots]) for c in (held[number].shard, held[number].offset, held[number].n))], placed_type.names)

    out_type = T.StructType([field, *T.StructType.fromDDL("nth long, start long, n_tokens long, ids binary").fields])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = local_fs(folder)
        held, file = None, None
        for b in batches:
            shard, at, n = (b.column(k).to_numpy() for k in ("shard", "at", "n"))
            if not payload:
                start = np.array([bases[s] for s in shard.tolist()], np.int64) + at
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("nth"), pa.array(start), pa.array(n), pa.nulls(b.num_rows, pa.binary())], out_type.names)
                continue
            begin = 0
            while begin < b.num_rows:
                cut, size = begin, 0
                while cut < b.num_rows and (cut == begin or size < 4_000_000):
                    size += int(n[cut])
                    cut += 1
                ids = []
                for i in range(begin, cut):
                    if shard[i] != held:
                        if file:
                            file.close()
                        held, file = shard[i], fs.open_input_file(f"{path}/shard-{shard[i]:06d}.bin")
                    file.seek(int(at[i]) * width)
                    raw = file.read(int(n[i]) * width)
                    ids.append(np.frombuffer(raw, "<u2").astype("<u4").tobytes() if width == 2 else raw)
                start = np.array([bases[int(s)] for s in shard[begin:cut]], np.int64) + at[begin:cut]
                yield pa.RecordBatch.from_arrays([b.column("key").slice(begin, cut - begin), b.column("nth").slice(begin, cut - begin), pa.array(start), pa.array(n[begin:cut]), pa.array(ids, pa.binary())], out_type.names)
                begin = cut
        if file:
            file.close()

    if not info["documents"]:
        return keys.sparkSession.createDataFrame([], out_type).withColumnRenamed("key", key)
    # About as many tasks as index parts, then as shards: each opens few files.
    placed = wanted.repartition("part").sortWithinPartitions("part").mapInArrow(place, placed_type) if parts > 1 else wanted.mapInArrow(place, placed_type)
    placed = placed.repartition("shard").sortWithinPartitions("shard", "at")
    return placed.mapInArrow(fetch, out_type).withColumnRenamed("key", key)
