"""MinHash near-dedup as an inverted join over signature coordinates.

Each distinct shingle set has a signature of COORDINATES minima and is posted under its
(coordinate, value) pairs. Sets that agree in at least MATCHES coordinates are candidates; as
they must then meet under one of their rarest pairs, only a prefix of these is posted, pairs
that one set alone has are skipped, and the agreeing coordinates are counted by comparing
signatures. Candidates become links if their full shingle sets, fetched for candidates alone, are
similar enough.

Groups are not expanded into pairs: a pair is looked at in the posting list of its first common
coordinate alone, and skipped if links found there have joined it already, so a list gives fewer
links than it has sets. Long lists are split into blocks: each block by itself first, then each
with the next one, which joins large groups of copies. Of lists whose sets are in different
components still, those outside the largest one go to all blocks; pairs within it are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Steps, by_class, small_batches
from .components import BROADCAST_NODES, LINKS, stars
from .sentencepiece_codec import by_size

#: Coordinates that are posted, and further ones of eight bits that candidates are compared in.
COORDINATES, WIDE = 32, 128
#: Sets of a posting list that are compared in one task.
BLOCK = 512

_rng = np.random.default_rng(10)
_BYTE = _rng.integers(0, 2**64, 256, np.uint64)
_MULTIPLY = _rng.integers(0, 2**63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _rng.integers(0, 2**64, COORDINATES, np.uint64)
_WIDE_MULTIPLY = _rng.integers(0, 2**63, WIDE, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out, inverse = np.ones(n, np.uint64), np.ones(n, np.uint64)
    out[1:], inverse[1:] = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 2**64))
    return np.multiply.accumulate(out), np.multiply.accumulate(inverse)


def shingles(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of each text, ascending, flat, and where each text starts.

    A-Z are lower-cased, words are what stands between blanks. With fewer than `words` words a
    text has its whole sequence as one shingle, without any it has none.
    """
    raw = b"".join(t.lower() + b" " for t in ((t or "").encode() for t in texts))
    data = np.frombuffer(raw, np.uint8)
    lengths = np.fromiter((len((t or "").encode()) + 1 for t in texts), np.int64, len(texts))
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate(([True], blank)).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(begin) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    power, inverse = _powers(len(data) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power[:-1], dtype=np.uint64)))
    word = _mixed((total[end] - total[begin]) * inverse[begin])
    bounds = np.searchsorted(begin, np.concatenate(([0], np.cumsum(lengths))))
    n = np.diff(bounds)
    sums = np.zeros(len(word), np.uint64)
    for k in range(words):
        sums[: max(0, len(word) - k)] += word[k:] * _PLACE[k] if k else word * _PLACE[0]
    found = _mixed(sums)
    out, starts = [], [0]
    for i in range(len(texts)):
        a, b = bounds[i], bounds[i + 1]
        if n[i] >= words:
            own = np.unique(found[a : b - words + 1])
        elif n[i]:
            own = _mixed(np.sum(word[a:b] * _PLACE[8 : 8 + n[i]], keepdims=True, dtype=np.uint64) + np.uint64(n[i]))
        else:
            own = found[:0]
        out.append(own)
        starts.append(starts[-1] + len(own))
    return np.concatenate(out), np.array(starts)


def signatures(found: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of minima for each text that has shingles, as signed 64-bit values that differ
    between coordinates."""
    some = np.flatnonzero(np.diff(starts))
    out = np.zeros((len(some), COORDINATES), np.int64)
    for j in range(COORDINATES):
        least = np.minimum.reduceat(_mixed((found ^ _FLIP[j]) * _MULTIPLY[j]), starts[some]) if len(some) else found[:0]
        out[:, j] = _mixed(least + np.uint64(j)).view(np.int64)
    return out


def wide_signatures(found: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Eight bits of each of WIDE further minima, a row for each text that has shingles."""
    some = np.flatnonzero(np.diff(starts))
    out = np.zeros((len(some), WIDE), np.int8)
    for j in range(WIDE if len(some) else 0):
        least = np.minimum.reduceat(_mixed(found * _WIDE_MULTIPLY[j]), starts[some])
        out[:, j] = (_mixed(least) >> np.uint64(56)).astype(np.uint8).view(np.int8)
    return out


def matches(percent: int, coordinates: int) -> int:
    """Coordinates that agree at least, but for 1 pair in 50,000, at a similarity of `percent`."""
    p = percent / 100
    return max(1, int(coordinates * p - 4.25 * (coordinates * p * (1 - p)) ** 0.5) + 1)


def features(docs: DataFrame, words: int, *, key: str, text: str) -> DataFrame:
    """Rows (id, n, d1, d2, signature): number and two digests of each text's shingle set."""
    schema = T.StructType([T.StructField("id", docs.schema[key].dataType), *T.StructType.fromDDL("n long, d1 long, d2 long, signature array<long>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_size(whole, 500_000):
                found, starts = shingles(b.column(1).to_pylist(), words)
                n = np.diff(starts)
                sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mixed(found ^ _FLIP[k]), dtype=np.uint64))) for k in (0, 1)]
                d1, d2 = ((s[starts[1:]] - s[starts[:-1]]).view(np.int64) for s in sums)
                offsets = np.concatenate(([0], np.cumsum(np.where(n > 0, COORDINATES, 0)))).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(signatures(found, starts).reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(d1), pa.array(d2), listed], schema.names)

    return docs.select(docs[key], docs[text].cast("string").alias("text")).mapInArrow(run, schema)


def _column(c: pa.Array, width: int) -> np.ndarray:
    """A column as an array, lists of one width as rows, other lists as objects."""
    if not pa.types.is_list(c.type):
        return c.to_numpy()
    ends, flat = np.diff(c.offsets.to_numpy()), c.flatten().to_numpy()
    if width:
        return flat.reshape(len(ends), width)
    out, at = np.empty(len(ends), object), 0
    for i, n in enumerate(ends.tolist()):
        out[i] = flat[at : at + n]
        at += n
    return out


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of each run of rows with equal first `n_keys` columns, from sorted batches."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [_column(c, WIDTHS.get(name, 0)) for name, c in zip(batch.schema.names, batch.columns, strict=True)]
        change = np.zeros(batch.num_rows - 1, bool)
        for k in range(n_keys):
            change |= columns[k][1:] != columns[k][:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = [c[a:b] for c in columns]
            if held and any(held[-1][k][0] != part[k][0] for k in range(n_keys)):
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held = []
            held.append(part)
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


#: Columns of the rows that meet in a posting list: where they do, the side they are on, whose
#: they are, the posted coordinate, the mask of the set's posted coordinates, its size and
#: signatures, and its whole shingle set.
MEETING = ("token", "block", "side", "node", "component", "pos", "mask", "n", "signature", "wide", "shingles")
WIDTHS = {"signature": COORDINATES, "wide": WIDE}


class _List:
    """One block of a posting list, or two, as arrays."""

    def __init__(self, columns: list[np.ndarray], percent: int):
        self.token, self.block, self.side, self.node, self.component, pos, self.mask, self.n, self.signature, self.wide, *rest = columns
        self.shingles = rest[0] if rest else None
        _, self.joined = np.unique(self.component, return_inverse=True)
        self.at, self.pos, self.percent = pos, int(pos[0]), percent
        self.narrow_least, self.wide_least = matches(percent, COORDINATES), matches(percent, WIDE)
        self.right = np.flatnonzero(self.side > 0)
        self.alone = bool((self.side == 1).any())

    def turns(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each row with those it may be compared with. Side 0 meets side 2, 1 itself."""
        for i in np.flatnonzero(self.side < 2).tolist():
            yield i, self.right[self.right > i] if self.alone else self.right

    def candidates(self, i: int, among: np.ndarray) -> np.ndarray:
        """Those of `among` that row i isn't joined with and may link with, by size and signatures."""
        low, high = np.minimum(self.n[among], self.n[i]), np.maximum(self.n[among], self.n[i])
        among = among[(self.joined[among] != self.joined[i]) & (100 * low >= self.percent * high)]
        same = self.signature[among] == self.signature[i]
        bits = (self.mask[among, None] & self.mask[i]) >> np.arange(COORDINATES) & 1
        # Pairs meet in several lists; the first one is theirs.
        among = among[(same.sum(1) >= self.narrow_least) & ((same & (bits == 1)).argmax(1) == self.pos)]
        return among[(self.wide[among] == self.wide[i]).sum(1) >= self.wide_least]

    def similar(self, i: int, among: np.ndarray) -> np.ndarray:
        """Those of `among` that row i links with and isn't joined with, by their full sets."""
        among = self.candidates(i, among)
        if not len(among):
            return among
        own, flat = self.shingles[i], np.concatenate(self.shingles[among])
        hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        sizes = np.fromiter(map(len, self.shingles[among]), np.int64, len(among))
        shared = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
        return among[100 * shared >= self.percent * (self.n[among] + self.n[i] - shared)]

    def links(self) -> Iterator[tuple[int, int]]:
        """Links that join rows which none before has joined."""
        for i, among in self.turns():
            for j in self.similar(i, among).tolist():
                if self.joined[i] != self.joined[j]:
                    self.joined[self.joined == self.joined[j]] = self.joined[i]
                    yield int(self.node[i]), int(self.node[j])

    def open(self) -> list[np.ndarray]:
        """Rows that have a candidate here; the others need no full set."""
        some = np.zeros(len(self.node), bool)
        for i, among in self.turns():
            found = self.candidates(i, among)
            some[found] = True
            some[i] |= len(found) > 0
        return [c[some] for c in (self.token, self.block, self.side, self.node, self.component, self.at)]


def _open(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, count = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], list(MEETING[:6]))

        for columns in _groups(batches, 2):
            out.append(_List(columns, percent).open())
            count += len(out[-1][0])
            if count > 8192 or len(out) > 8192:
                yield batch()
                out, count = [], 0
        if out:
            yield batch()

    return run


def _links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for columns in _groups(batches, 2):
            out += _List(columns, percent).links()
            if len(out) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    return run


def _widened(texts: DataFrame, words: int) -> DataFrame:
    """Rows (node, n, wide, shingles) of texts that have shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_size(whole, 500_000):
                found, starts = shingles(b.column(1).to_pylist(), words)
                n = np.diff(starts)
                some = np.flatnonzero(n)
                offsets = (np.arange(len(some) + 1) * WIDE).astype(np.int32)
                # Ascending as unsigned numbers, kept so as signed ones.
                upper = (found ^ np.uint64(2**63)).view(np.int64)
                whole_sets = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n[some]))).astype(np.int32)), pa.array(upper))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), pa.array(n[some]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(wide_signatures(found, starts).reshape(-1))), whole_sets], ["node", "n", "wide", "shingles"])

    return texts.mapInArrow(run, "node long, n long, wide array<tinyint>, shingles array<long>")


def _small(joined: DataFrame) -> DataFrame:
    """Joined nodes, broadcast if they are few."""
    return F.broadcast(joined) if joined.count() <= BROADCAST_NODES else joined


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_shingles, component_id, kept), one for each row of `docs`.

    Sets are the distinct shingles of `words` words of whole texts; sets link with
    100 * intersection >= `percent` * union, equal ones always. `component_id` is the least
    key reachable by links, `kept` marks the row that has it. Null and empty texts and texts of
    blanks have no shingles and link with nothing. Rows with equal keys are one node and count
    alike. Rows with a null key link with nothing, have no component and are kept. Keys are
    integers. Other columns are not read. An empty table gives no rows.
    """
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, words, percent, key, text)


def _near_duplicates(docs: DataFrame, words: int, percent: int, key: str, text: str) -> DataFrame:
    steps = Steps(docs.sparkSession)
    found = steps.saved(features(docs, words, key=key, text=text), "features")
    linked = found.where("n > 0 and id is not null")
    classes = steps.saved(linked.groupBy("n", "d1", "d2").agg(F.min("id").cast("long").alias("node"), F.count("*").alias("copies")), "classes")
    members = steps.saved(by_class(linked, classes, ["n", "d1", "d2"], linked.count()).select("id", "n", "node", F.when(F.col("id") == F.col("node"), F.col("signature")).alias("signature")), "members")
    rest = steps.saved(found.where("n = 0 or id is null").select("id", "n"), "rest")
    steps.drop(found, classes)
    nodes = members.where("signature is not null").select("node", "n", "signature")
    least = matches(percent, COORDINATES)
    posted = nodes.select("node", F.posexplode("signature").alias("pos", "token"))
    # Coordinates that a thousandth of all sets' postings share go to the postings, not these to them.
    shared = steps.saved(posted.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    by_node = Window.partitionBy("node")
    ranked = by_class(posted, shared, ["token"], nodes.count() * COORDINATES, "df").select("*", F.count("*").over(by_node).alias("c"), F.row_number().over(by_node.orderBy("df", "token")).alias("nth"))
    chosen = ranked.where((F.col("c") >= least) & (F.col("nth") <= F.col("c") - least + 1))
    prefix = steps.saved(chosen.select("token", "pos", "node", F.ceil(F.col("df") / BLOCK).cast("int").alias("blocks")).distinct(), "postings")
    steps.drop(shared)
    masks = prefix.groupBy("node").agg(F.bit_or(F.expr("shiftleft(1L, pos)")).alias("mask"))
    # Texts move by their key at every size: a side that fits a broadcast today won't tomorrow.
    texts = docs.select(docs[key].cast("long").alias("node"), docs[text].cast("string").alias("text")).join(masks.select("node").hint("merge"), "node", "left_semi")
    candidates = steps.saved(nodes.join(masks, "node").join(_widened(texts, words), ["node", "n"]).distinct(), "candidates")
    joined: DataFrame | None = None  # the nodes that links have joined to lesser ones, as stars
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("long")
    for turn, more in (("within", 0), ("next", 1), ("all", 2)):
        met = prefix.where(f"blocks > {more}").withColumn("own", block)
        if joined is None:
            met = met.withColumn("component", F.col("node"))
        else:
            met = met.join(_small(joined).withColumnsRenamed({"a": "node", "b": "component"}), "node", "left").withColumn("component", F.coalesce("component", "node"))
        if turn == "within":
            met = met.withColumns({"block": F.col("own"), "side": F.lit(1)})
        else:
            split = met.groupBy("token", "component", "blocks").agg(F.count("*").alias("n"))
            split = split.groupBy("token", "blocks").agg(F.max_by("component", F.struct("n", "component")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
            # A row for each block, so that a long list is met block by block.
            split = split.select("token", "most", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("own"))
            met = met.join(split, ["token", "own"])
            if turn == "next":
                places = F.array(F.struct(F.col("own").alias("block"), F.lit(0).alias("side")), F.struct(F.pmod(F.col("own") - 1, F.col("blocks")).alias("block"), F.lit(2).alias("side")))
            else:
                there = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
                home = F.array(F.struct(F.col("own").alias("block"), F.lit(2).alias("side")))
                visits = F.transform(F.filter(there, lambda b: b != F.col("own")), lambda b: F.struct(b.alias("block"), F.lit(0).alias("side")))
                places = F.when(F.col("component") == F.col("most"), home).otherwise(F.concat(home, visits))
            met = met.withColumn("place", F.explode(places)).select("token", "pos", "node", "component", "place.block", "place.side")
        met = met.select("token", F.col("block").cast("long").alias("block"), F.col("side").cast("int").alias("side"), "node", "component", "pos")
        rows = met.join(candidates.drop("shingles"), "node").select(*MEETING[:-1])
        some = rows.repartition("token", "block").sortWithinPartitions("token", "block", "node").mapInArrow(_open(percent), "token long, block long, side int, node long, component long, pos int")
        open_ = steps.saved(some, "open")
        rows = open_.join(candidates, "node").select(*MEETING)
        found_links = rows.repartition("token", "block").sortWithinPartitions("token", "block", "node").mapInArrow(_links(percent), LINKS)
        pairs = steps.saved(found_links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "pairs")
        steps.drop(open_)
        if not pairs.isEmpty():
            old, joined = joined, stars(pairs if joined is None else joined.union(pairs), steps)
            steps.drop(old)
        steps.drop(pairs)
        if prefix.where(f"blocks > {more + 1}").isEmpty():
            break
    joined = docs.sparkSession.createDataFrame([], LINKS) if joined is None else joined
    joined = _small(joined).select(F.col("a").alias("node"), F.col("b").alias("component"))
    named = members.groupBy("node").agg(F.count("*").alias("copies")).join(joined, "node", "left")
    named = steps.saved(named.select("node", "copies", F.coalesce("component", "node").alias("component_id")), "named")
    out = by_class(members.select("id", "n", "node"), named, ["node"], members.count()).select("id", "n", "component_id")
    rest = rest.select("id", "n", F.when(F.col("id").isNotNull(), F.col("id").cast("long")).alias("component_id"))
    last = steps.saved(out.union(rest).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")), "groups")
    steps.drop(*(df for df, _ in steps.made if df is not last))
    return last
