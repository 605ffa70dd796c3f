"""Connected components of a link table, without ever holding a component in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Steps

LINKS = "a long, b long"
#: Nodes whose least neighbours are broadcast, at most.
BROADCAST_NODES = 200_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition as stars around the least node of each local component, part by
    part: a union-find over at most a million links at a time."""

    def stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = list(range(len(nodes)))
        for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            while root[y] != y:
                root[y] = root[root[y]]
                y = root[y]
            if x != y:
                root[max(x, y)] = min(x, y)
        for x in range(len(root)):  # roots come before what hangs on them
            root[x] = root[root[x]]
        root = np.array(root, np.int64)
        keep = root != np.arange(len(root))
        return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(nodes[root[keep]])], ["a", "b"])

    held, count = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        count += batch.num_rows
        if count >= 1_000_000:
            yield stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held, count = [], 0
    if count:
        yield stars(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _few(table: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """How to join what has no more rows than `table`: it is broadcast if these are few."""
    return F.broadcast if table.count() <= BROADCAST_NODES else lambda df: df


def stars(links: DataFrame, steps: Steps) -> DataFrame:
    """Rows (a, b) of all nodes in `links` (a, b) but the least one of each component, which is b.

    Links within a partition are first reduced to stars. Then large-star and small-star steps
    alternate (each node's larger neighbours, then its smaller ones, move to the least of them)
    until all links are stars, in a number of rounds that grows with the logarithm of the
    longest path. Self-links, repeated links and either direction are allowed; no links, no rows.
    A node's least neighbour goes to the links by a broadcast as long as nodes are few.
    """
    links = links.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a <> b")
    now = steps.saved(links.mapInArrow(_forest, LINKS).distinct(), "stars")
    while True:
        both = now.union(now.select("b", "a"))
        # Links up and down of each node: stars have one link to a node that has none up.
        ends = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count_if(F.col("b") < F.col("a")).alias("up"), F.max((F.col("b") > F.col("a")).cast("int")).alias("down"))
        ends = steps.saved(ends, "ends")
        if ends.where("up > 0 and up + down > 1").isEmpty():
            steps.drop(ends)
            return now
        few = _few(ends)
        large = both.where("b > a").join(few(ends.select("a", "m")), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        joined = large.join(few(large.groupBy("a").agg(F.min("b").alias("m"))), "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", "m")).where("a <> b")
        last, now = now, steps.saved(small.mapInArrow(_forest, LINKS).distinct(), "stars")
        steps.drop(last, ends)


def components(links: DataFrame, steps: Steps | None = None) -> DataFrame:
    """Rows (node, component) of all nodes in `links` (a, b), components by their least node, as
    `stars` finds them. They are read from the last table written, which `steps` can drop."""
    now = stars(links, steps or Steps(links.sparkSession))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
