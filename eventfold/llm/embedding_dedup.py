"""Near-duplicate embeddings: cross-polytope hashing after fast Hadamard rotations.

A hash of a unit vector is the signed axis that a random rotation (three rounds of sign flips
and fast Hadamard transforms) brings it nearest to; a table's bucket is made of HASHES of them.
Each vector lies in its own bucket of every table and also visits the PROBES buckets that a
small change of it would fall into. Vectors that meet in a bucket are candidates; they are
verified by their cosine in double precision where they first meet. No pair leaves a task: what
does is each vector's number of links there, and one link that joins it to its group there.
Equal vectors are hashed once. Large buckets are split into blocks that meet pairwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Steps, by_class
from .components import components

TABLES, HASHES, PROBES = 8, 2, 6
#: Hashes of a bucket at most: with more of them fewer pairs at a cosine of 0.98 meet.
MOST_HASHES = 5
#: Vectors of one label to a bucket, on average, beyond which a bucket is made of more hashes.
FULL = 0.25
#: Vectors of a bucket that are compared in one task.
BLOCK = 512


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, whose length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate((y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]), axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def hashes_for(vectors: int, width: int) -> int:
    """Hashes of a bucket, so that unlike vectors seldom share one: HASHES, and one more each
    time that a label's vectors outgrow the buckets, as long as vectors at the least cosine still
    meet. Fuller buckets are compared whole, block by block."""
    axes = 2 << max(1, (width - 1).bit_length())
    return max(HASHES, min(4 if width <= 4 else MOST_HASHES, math.ceil(math.log(max(1, vectors / FULL)) / math.log(axes))))


def buckets(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> np.ndarray:
    """Bucket numbers of each unit vector: (rows, tables, 1 + probes), its own first; -1 where a
    narrow vector has fewer buckets to visit."""
    size = 1 << max(1, (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), size))
    padded[:, : x.shape[1]] = x
    out = np.full((len(x), tables, 1 + probes), -1, np.int64)
    rows = np.arange(len(x))
    for t in range(tables):
        own, second, loss = [], [], []
        for h in range(hashes):
            rng = np.random.default_rng([4, t, h])
            y = padded
            for _ in range(3):
                y = _hadamard(y * rng.choice([-1.0, 1.0], size))
            near = np.argsort(-np.abs(y), axis=1, kind="stable")[:, : probes + 1]
            value = np.take_along_axis(y, near, 1)
            axis = 2 * near + (value < 0)
            # What a probe costs: how far the axis' coordinate lies below the largest.
            own.append(axis[:, 0])
            second.append(axis[:, 1:])
            loss.append((np.abs(value[:, :1]) - np.abs(value[:, 1:])) ** 2)
        code = sum(own[h] * (2 * size) ** h for h in range(hashes))
        changed = np.concatenate([code[:, None] + (second[h] - own[h][:, None]) * (2 * size) ** h for h in range(hashes)], 1)
        best = np.argsort(np.concatenate(loss, 1), axis=1, kind="stable")[:, :probes]
        out[rows, t, 0] = code
        out[:, t, 1:][:, : best.shape[1]] = np.take_along_axis(changed, best, 1)
    return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled by their largest component first, so that no square of a
    component leaves the range of double precision."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds `codes`, the bucket numbers of all tables, flat."""
    for b in batches:
        dim, k = b.column("dim").to_numpy(), b.column("hashes").to_numpy()
        for d, hashes in sorted(set(zip(dim.tolist(), k.tolist(), strict=True))):
            part = b.take(pa.array(np.flatnonzero((dim == d) & (k == hashes))))
            for at in range(0, part.num_rows, 2048):
                some = part.slice(at, 2048)
                found = buckets(_unit(some.column("vector").flatten().to_numpy().reshape(some.num_rows, d)), hashes=hashes)
                width = found.shape[1] * found.shape[2]
                codes = pa.ListArray.from_arrays(pa.array(np.arange(some.num_rows + 1, dtype=np.int32) * width), pa.array(found.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*some.columns, codes], [*some.schema.names, "codes"])


def _first_meeting(a: np.ndarray, b: np.ndarray, table: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Of pairs with their codes (pairs, tables, 1 + probes), those that meet in this table and
    bucket for the first time: in no earlier table, and in the own bucket of the first or, if
    that is no meeting, in that of the second."""
    of_a, of_b = (a[:, :, :1] == b).any(2), (b[:, :, :1] == a).any(2)
    some = of_a | of_b
    first = some.argmax(1)
    rows = np.arange(len(a))
    at = np.where(of_a[rows, first], a[rows, first, 0], b[rows, first, 0])
    return some[rows, first] & (first == table) & (at == bucket)


def _grouped(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row of each row's group, by links i, j."""
    root = list(range(n))
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        while root[y] != y:
            root[y] = root[root[y]]
            y = root[y]
        if x != y:
            root[max(x, y)] = min(x, y)
    for x in range(n):
        root[x] = root[root[x]]
    return np.array(root, np.int64)


def _verified(least: float):
    """(node, n, root) of each vector with links at a place: how many rows it links with there
    for the first time, and the node that stands for its group there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bucket, _, side, own, node, copies, codes, vectors in _places(batches):
            x, c = _unit(np.stack(vectors)), np.stack(codes).reshape(len(node), TABLES, -1)
            left, right = (np.arange(len(node)),) * 2 if (side == 1).all() else (np.flatnonzero(side < 2), np.flatnonzero(side == 2))
            if not len(left) or not len(right):
                continue
            i, j = np.nonzero(x[left] @ x[right].T >= least - 1e-9)
            i, j = left[i], right[j]
            keep = (own[i] | own[j]) & ((node[i] < node[j]) | ((side[i] != 1) & (node[i] != node[j])))
            i, j = i[keep], j[keep]
            count, links = np.zeros(len(node), np.int64), []
            for at in range(0, len(i), 16384):
                a, b = i[at : at + 16384], j[at : at + 16384]
                exact = np.einsum("ij,ij->i", x[a], x[b]) >= least
                a, b = a[exact], b[exact]
                swap = node[a] > node[b]
                a, b = np.where(swap, b, a), np.where(swap, a, b)
                first = _first_meeting(c[a], c[b], table[0], bucket[0])
                a, b = a[first], b[first]
                for to, of in ((a, b), (b, a)):
                    count += np.bincount(to, copies[of], len(node)).astype(np.int64)
                links.append((a, b))
            some = np.flatnonzero(count)
            if len(some):
                root = _grouped(len(node), *(np.concatenate(x) for x in zip(*links, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(count[some]), pa.array(node[root[some]])], ["node", "n", "root"])

    return run


def near_duplicates(vectors: DataFrame, *, least: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Rows (key, n_links, component_id, kept), one for each row of `vectors`.

    Vectors of equal label and length link with a cosine of `least` or more, equal ones always.
    `n_links` counts the other rows linked directly, `component_id` is the least key reachable,
    `kept` marks rows that have it. Rows whose vector is null, empty, zero or has null or
    non-finite components, and rows without a label, link with nothing; so do rows with a null
    key, which have no component and are kept. Keys are integers. Each row is a vector of its own:
    rows with equal vectors link with each other, whether their keys are equal or not, and rows
    with equal keys and different vectors have each their own links. Other columns are not read.
    An empty table gives no rows.
    """
    steps = Steps(vectors.sparkSession)
    whole = F.transform(vectors[vector], lambda v: v.cast("double"))
    rows = vectors.select(vectors[key].alias("id"), vectors[label].alias("label"), whole.alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    sound = F.coalesce(F.col("label").isNotNull() & F.col("id").isNotNull() & finite & F.exists("vector", lambda v: v != 0), F.lit(False))
    # Equal vectors (0.0 and -0.0 alike) form a class, by a digest of 128 bits.
    flat = F.transform("vector", lambda v: F.when(v == 0, F.lit(0.0)).otherwise(v))
    rows = rows.withColumn("vector", flat).select("*", F.xxhash64("label", "vector").alias("d1"), F.xxhash64("vector", "label", F.lit(4)).alias("d2"), sound.alias("sound"))
    by = ["label", "d1", "d2"]
    found = steps.saved(rows.select("id", *by, "sound"), "rows")
    classes = rows.where("sound").groupBy(*by).agg(F.min("id").cast("long").alias("least"), F.count("*").alias("copies"), F.any_value("vector").alias("vector"))
    # Numbers of the classes hold from here on, as the table is written.
    classes = steps.saved(classes.select("*", F.size("vector").alias("dim"), F.monotonically_increasing_id().alias("node")), "classes")
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).groupBy("dim").agg(F.max("n").alias("n")).collect()  # bounded: a row for each width
    hashes = F.coalesce(*(F.when(F.col("dim") == r["dim"], hashes_for(r["n"], r["dim"])) for r in sizes), F.lit(HASHES)).cast("int")
    nodes = classes.select("label", "dim", hashes.alias("hashes"), "node", "copies", "vector")
    nodes = steps.saved(nodes.mapInArrow(_hashed, T.StructType([*nodes.schema.fields, T.StructField("codes", T.ArrayType(T.LongType()))])), "nodes")
    each = nodes.select("label", "dim", "node", F.posexplode("codes").alias("at", "bucket"))
    posted = steps.saved(each.select("label", "dim", "node", "bucket", F.floor(F.col("at") / (1 + PROBES)).cast("int").alias("table"), (F.col("at") % (1 + PROBES) == 0).alias("own")).where("bucket >= 0"), "posted")
    key_of = ["label", "dim", "table", "bucket"]
    # Buckets in which a vector lies and another lies or visits.
    full = posted.groupBy(*key_of).agg(F.count("*").alias("n"), F.max("own").alias("any")).where("n > 1 and any").select(*key_of, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")).cast("int")
    meeting = posted.join(full, key_of).withColumn("block", block).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    pair = F.least("block", "with") * F.col("blocks") + F.greatest("block", "with")
    side = F.when(F.col("block") < F.col("with"), 0).when(F.col("block") == F.col("with"), 1).otherwise(2)
    meeting = meeting.select("table", "bucket", F.xxhash64("label", "dim", pair).alias("place"), side.cast("int").alias("side"), "own", "node")
    meeting = meeting.join(nodes.select("node", "copies", "codes", "vector"), "node").select(*PLACE, "side", "own", "node", "copies", "codes", "vector")
    there = steps.saved(meeting.repartition(*PLACE).sortWithinPartitions(*PLACE).mapInArrow(_verified(least), "node long, n long, root long"), "links")
    steps.drop(posted, nodes)
    joined = components(there.select(F.col("node").alias("a"), F.col("root").alias("b")), steps)
    counted = there.groupBy("node").agg(F.sum("n").alias("n"))
    named = classes.select("node", *by, "copies", "least").join(joined, "node", "left").join(counted, "node", "left").withColumn("group", F.coalesce("component", "node"))
    named = steps.saved(named.select(*by, "group", "least", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named")
    firsts = named.groupBy("group").agg(F.min("least").alias("component_id"))
    named = steps.saved(named.join(firsts, "group").select(*by, "copies", "n_links", "component_id"), "named")
    sound = found.where("sound").select("id", *by)
    out = by_class(sound, named, by, sound.count()).select("id", "n_links", "component_id")
    rest = found.where("not sound").select("id", F.lit(0).cast("long"), F.col("id").cast("long"))
    last = steps.saved(out.union(rest).select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")), "groups")
    steps.drop(*(df for df, _ in steps.made if df is not last))
    return last


#: What rows that meet share: table, bucket, and a hash of label, width and pair of blocks.
PLACE = ["table", "bucket", "place"]


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """Columns of each run of rows with equal PLACE, from sorted batches; lists as arrays."""
    held: list | None = None

    def lists(column: pa.ListArray) -> list[np.ndarray]:
        flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
        return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    for b in batches:
        if not b.num_rows:
            continue
        columns = [lists(c) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False) for c in b.columns]
        change = np.zeros(b.num_rows - 1, bool)
        for k in range(len(PLACE)):
            change |= columns[k][1:] != columns[k][:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
        for a, e in zip(cuts, cuts[1:], strict=False):
            part = [c[a:e] for c in columns]
            if held is not None and all(held[k][0] == part[k][0] for k in range(len(PLACE))):
                held = [x + y if isinstance(x, list) else np.concatenate((x, y)) for x, y in zip(held, part, strict=True)]
            else:
                if held is not None:
                    yield held
                held = part
    if held is not None:
        yield held
