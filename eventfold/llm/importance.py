"""Importance resampling towards a target distribution of hashed word features.

A feature is a run of one to `most` words of a text. Its CRC-32, modulo a number of buckets, names
its bucket. Buckets are counted over the source texts and over the target texts; the ratio of both
gives each bucket a gain, a document weighs the sum of its features' gains, and documents are drawn
by weight plus Gumbel noise of their key, the highest first.

Tasks keep their features in a trie of words: a node holds how often its run occurs and the CRC
state of its bytes, so that a run longer by a word goes on from the state of the run before it.
Counting walks the trie and adds up; scoring walks a trie whose nodes carry their bucket's gain.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_words import LETTERS, cut
from .common import Steps, ranked, small_batches
from .sentencepiece_codec import by_size

BUCKETS = 10_000
#: Nodes of a task's trie; a full trie gives its counts away and begins anew.
NODES = 200_000
#: Bytes of text that are walked together.
TOGETHER = 2_000_000
#: Documents with fewer words aren't drawn; per cent of the others that are.
LEAST_WORDS, DRAWN = 20, 10
SEED = 2024


class Trie:
    """Runs of words as paths from the root, which is node 0."""

    def __init__(self, buckets: int, gains: np.ndarray | None = None):
        self.buckets, self.gains = buckets, gains
        self.children: dict[tuple[int, bytes], int] = {}
        self.state, self.counts = [0], np.zeros(1024, np.int64)

    def __len__(self) -> int:
        return len(self.state)

    def child(self, node: int, word: bytes) -> int:
        """The node that `word` leads to from `node`, made if there is none."""
        found = self.children.get((node, word))
        if found is None:
            found = self.children[node, word] = len(self.state)
            self.state.append(zlib.crc32(b" " + word if node else word, self.state[node]))
        return found

    def walk(self, words: pa.DictionaryArray, text: np.ndarray, most: int) -> Iterator[np.ndarray]:
        """For runs of one word, of two and so on the node that each one ends at; a run of k words
        that begins at word i is at place i, and 0 where its text ends before."""
        index = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        spelled = words.dictionary.to_pylist()
        first = np.array([self.child(0, w) for w in spelled], np.int64)
        at = first[index] if len(spelled) else np.zeros(0, np.int64)
        yield at
        for k in range(1, most):
            at = at[:-1].copy() if len(at) else at
            same = np.flatnonzero((text[: len(at)] == text[k : k + len(at)]) & (at > 0))
            keys, which = np.unique(at[same] * len(spelled) + index[same + k], return_inverse=True)
            longer = np.array([self.child(key // len(spelled), spelled[key % len(spelled)]) for key in keys.tolist()], np.int64)
            at[:] = 0
            at[same] = longer[which] if len(keys) else 0
            yield at

    def count(self, nodes: np.ndarray) -> None:
        if len(self.counts) < len(self.state):
            self.counts = np.concatenate([self.counts, np.zeros(len(self.state), np.int64)])
        self.counts += np.bincount(nodes, minlength=len(self.counts))

    def bucket_of(self, nodes: slice = slice(1, None)) -> np.ndarray:
        return np.array(self.state[nodes], np.int64) % self.buckets

    def totals(self) -> np.ndarray:
        """Occurrences of all features in each bucket."""
        return np.bincount(self.bucket_of(), self.counts[1 : len(self.state)], self.buckets).astype(np.int64)

    def gain_of(self) -> np.ndarray:
        """Each node's gain, the root's is 0."""
        return np.concatenate(([0], self.gains[self.bucket_of()])).astype(np.int64)


def bucket_counts(texts: DataFrame, *, text: str = "text", most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Rows (bucket, n) of the buckets that have a feature, over all rows of `texts`: a task gives
    a row a bucket each time its trie is full and at its end; the totals are merged by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(buckets)

        def told() -> pa.RecordBatch:
            sums = trie.totals()
            there = np.flatnonzero(sums)
            return pa.RecordBatch.from_arrays([pa.array(there), pa.array(sums[there])], ["bucket", "n"])

        for whole in batches:
            for b in by_size(whole, TOGETHER):
                words, of, _, _ = cut(b.column(1).to_pylist(), LETTERS)
                for nodes in trie.walk(words, of, most):
                    trie.count(nodes)
                if len(trie) > NODES:
                    yield told()
                    trie = Trie(buckets)
        yield told()

    each = texts.select(F.lit(0).alias("key"), texts[text].cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket from rows (bucket, n) of source and target, `buckets` rows each at most."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for into, rows in ((s, source), (t, target)):
        for r in rows.collect():
            into[r["bucket"]] = r["n"]
    total_s, total_t = int(s.sum()) + buckets, int(t.sum()) + buckets
    return np.array([math.floor(1000 * math.log((b + 1) * total_s / ((a + 1) * total_t))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, *, key: str = "doc_id", text: str = "text", most: int = 1) -> DataFrame:
    """Rows (key, n_words, n_features, weight), one for each row of `docs`."""
    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    schema = T.StructType([rows.schema["key"], *T.StructType.fromDDL("n_words long, n_features long, weight long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(len(gain), gain)
        for whole in batches:
            for b in by_size(whole, TOGETHER):
                words, of, _, n_words = cut(b.column(1).to_pylist(), LETTERS)
                ends = np.cumsum(n_words)
                n_features, weight = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
                for nodes in trie.walk(words, of, most):
                    # Sums of each text's part of the walk, from running totals.
                    for sums, value in ((n_features, nodes > 0), (weight, trie.gain_of()[nodes])):
                        running = np.concatenate(([0], np.cumsum(value, dtype=np.int64)))
                        cuts = running[np.minimum(np.concatenate(([0], ends)), len(nodes))]
                        sums += np.diff(cuts)
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (n_words, n_features, weight))], schema.fieldNames())
                if len(trie) > NODES:
                    trie = Trie(len(gain), gain)

    return rows.mapInArrow(run, schema)


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, from the SHA-256 of seed and key."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, *, key: str = "doc_id", text: str = "text", most: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = DRAWN, seed: int = SEED) -> DataFrame:
    """Rows (key, n_words, n_features, weight, score, rank), one for each row of `docs`.

    Of the N rows with at least `least_words` words floor(percent * N / 100) are drawn, those with
    the highest scores, equal scores by ascending key, null keys last; their ranks are 1, 2, 3 and
    so on, the others' null. Rows of equal score and key are ordered by weight and place. Null and
    empty texts have no features, weight 0 and no rank. An empty table gives no rows; an empty
    target gives gains from the source alone. Other columns are not read.
    """
    steps = Steps(docs.sparkSession)
    with small_batches(docs.sparkSession):
        gain = gains(bucket_counts(docs, text=text, most=most, buckets=buckets), bucket_counts(target, text=text, most=most, buckets=buckets), buckets)
        scored = weighed(docs, gain, key=key, text=text, most=most).withColumn("score", F.col("weight") + noise(F.col("key"), seed))
        scored = steps.saved(scored, "scored")
    long_enough = F.col("n_words") >= least_words
    drawn = scored.where(long_enough).count() * percent // 100
    placed = ranked(scored, [(~long_enough).alias("short"), F.col("score").desc(), F.col("key").asc_nulls_last(), F.col("weight").desc()], "place", steps)
    steps.drop(scored)
    rank = F.when(F.col("place") <= drawn, F.col("place"))
    return placed.select(F.col("key").alias(key), "n_words", "n_features", "weight", "score", rank.alias("rank"))
