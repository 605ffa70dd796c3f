"""Toxicity of texts: bags of subword embeddings under a linear softmax.

A word is the mean of the vectors of its character n-grams (hashed, with word ends), so a
misspelling unseen in training shares most vectors with the word it comes from. The words of
a short window are averaged and a linear softmax over the average gives the window's score;
a text scores as its worst window, as a long text with one insult is toxic too. Embeddings
and softmax are trained together in numpy, on the windows that score highest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chars import SPACE, grams, text_groups, words_of
from .common import Steps
from .sentencepiece_codec import by_size

#: Labelled rows that are fitted on, of each label.
TRAIN_TOXIC, TRAIN_CLEAN = 1500, 3000
BUCKETS = 1 << 18
ORDERS = (3, 4, 5)
#: Words of a window, half of which the next one shares.
WINDOW = 8
DIMENSIONS = 4
#: Texts of each label of which all windows are trained on at first.
START_TEXTS = 200
#: Slopes below this move an embedding less than others: what a few texts share weighs little.
DAMPING = 1e-4


def _spans(chars: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each word (its space), and the first word of each text, with the total last."""
    space = np.flatnonzero(chars == SPACE)
    word = space[:-1][np.diff(space) > 1] if len(space) > 1 else space[:0]
    return word, np.searchsorted(word, starts)


def _grams(chars: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: positions whose n-gram lies in one word with its two ends, and buckets."""
    inside = np.concatenate(([0], np.cumsum(chars == SPACE)))
    for n in ORDERS:
        size = max(0, len(chars) - n + 1)
        at = np.flatnonzero(inside[n - 1 : n - 1 + size] == inside[1 : 1 + size])
        yield at, grams(chars, n, BUCKETS)[at]


def _windows(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end word of every window, and the first window of each text, of the texts'
    word bounds. A text has one window at least, which may be empty."""
    n, step = np.diff(words), WINDOW // 2
    count = np.maximum(1, -(-(n - WINDOW) // step) + 1)
    first = np.concatenate(([0], np.cumsum(count)))
    text = np.repeat(np.arange(len(n)), count)
    begin = words[:-1][text] + step * (np.arange(first[-1]) - first[:-1][text])
    return begin, np.minimum(begin + WINDOW, words[1:][text]), first


@dataclass
class ToxicityModel:
    pull: np.ndarray  # of each bucket: its embedding times the softmax' difference of classes
    bias: float
    empty: float = -4.0  # log odds of a window without words

    def windows(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """Log odds of all windows, first window of each text, and where the windows lie."""
        chars, starts = words_of(texts, digits=True)
        word, bounds = _spans(chars, starts)
        total, number = np.zeros(len(chars) + 1), np.zeros(len(chars) + 1)
        for at, bucket in _grams(chars):
            total[at] += self.pull[bucket]
            number[at] += 1
        value = np.zeros(0)
        if len(word):  # an n-gram that starts in a word, or at its space, is the word's
            value = np.add.reduceat(total, word) / np.maximum(1, np.add.reduceat(number, word))
        begin, end, first = _windows(bounds)
        sums = np.concatenate(([0.0], np.cumsum(value)))
        logit = np.where(end > begin, (sums[end] - sums[begin]) / np.maximum(1, end - begin) + self.bias, self.empty)
        return logit, first, begin, end, word, chars

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = [np.zeros(0)]
        for part in text_groups(np.fromiter((len(t or "") + 20 for t in texts), np.int64, len(texts))):
            logit, first, *_ = self.windows(texts[part])
            out.append(np.maximum.reduceat(logit, first[:-1]))
        return 1 / (1 + np.exp(-np.clip(np.concatenate(out), -500, 500)))


class _Trainer:
    """Embeddings and softmax with their Adam state; steps over bags of words."""

    def __init__(self):
        rng = np.random.default_rng(3)
        self.params = [rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)), rng.normal(0, 0.1, (DIMENSIONS, 2)), np.zeros(2)]
        self.state = [[np.zeros_like(p), np.zeros_like(p)] for p in self.params]
        self.steps = 0

    def model(self) -> ToxicityModel:
        e, u, b = self.params
        return ToxicityModel(e @ (u[:, 1] - u[:, 0]), float(b[1] - b[0]))

    def run(self, windows: list[str], text: np.ndarray, y: np.ndarray, rounds: int) -> None:
        """Steps over windows, `text` has the number of each one's text, ascending. A text
        counts by its worst windows, toxic and clean texts count alike in all."""
        split = [w.split() for w in windows]
        numbers: dict[str, int] = {}
        number = np.fromiter((numbers.setdefault(w, len(numbers)) for words in split for w in words), np.int32)
        # Each distinct word's n-grams, in buckets numbered anew.
        chars, starts = words_of([" ".join(numbers)], digits=True)
        word, _ = _spans(chars, starts)
        at, bucket = (np.concatenate(x) for x in zip(*_grams(chars), strict=True))
        owner = (np.searchsorted(word, at, "right") - 1).astype(np.int32)
        known, bucket = np.unique(bucket, return_inverse=True)
        bucket = bucket.astype(np.int32)
        del at, chars
        share = (1.0 / np.maximum(1, np.bincount(owner, minlength=len(word))))[owner]
        size = np.fromiter(map(len, split), np.int64, len(split))
        window_of = np.repeat(np.arange(len(windows), dtype=np.int32), size)
        part = (1.0 / np.maximum(1, size))[window_of]
        _, first, per = np.unique(text, return_index=True, return_counts=True)
        group = np.repeat(np.arange(len(first)), per)
        label = y[text].astype(np.float64)
        even = np.where(label == 1, 0.5 / max(1, y[text[first]].sum()), 0.5 / max(1, (1 - y[text[first]]).sum()))
        # Sums of rows of `value` by `to`, a column at a time.
        tally = lambda to, value, at, weight, n: np.stack([np.bincount(to, value[:, k][at] * weight, n) for k in range(value.shape[1])], 1)
        e, u, b = self.params
        for _ in range(rounds):
            self.steps += 1
            vectors = tally(owner, e[known], bucket, share, len(word))
            bag = tally(window_of, vectors, number, part, len(windows))
            z = (bag @ u + b) @ np.array([-1.0, 1.0])
            sharp = 3.0 if self.steps > 8 else 0.5
            worst = np.exp(np.clip(sharp * (z - np.maximum.reduceat(z, first)[group]), -40, 0))
            worst /= np.add.reduceat(worst, first)[group]
            off = even * worst * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label)
            out = np.stack([-off, off], 1)
            back = tally(number, out @ u.T, window_of, part, len(word))
            slopes = [tally(bucket, back, owner, share, len(known)), bag.T @ out, out.sum(0)]
            for k, (slope, rate) in enumerate(zip(slopes, (0.3, 0.05, 0.05), strict=True)):
                at = known if k == 0 else slice(None)
                m, v = self.state[k]
                m[at] = 0.9 * m[at] + 0.1 * slope
                v[at] = 0.98 * v[at] + 0.02 * slope * slope
                self.params[k][at] -= rate * (m[at] / (1 - 0.9**self.steps)) / (np.sqrt(v[at] / (1 - 0.98**self.steps)) + (DAMPING if k == 0 else 1e-7))


def _cut(model: ToxicityModel, texts: list[str], most: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The `most` windows of each text that score highest, their texts' numbers, and each
    text's highest log odds."""
    out, number, top, done = [], [], [], 0
    for part in text_groups(np.fromiter((len(t) + 20 for t in texts), np.int64, len(texts)), 400_000):
        logit, first, begin, end, word, chars = model.windows(texts[part])
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        order = np.lexsort((-logit, text))
        order = order[(np.arange(len(order)) - first[:-1][text[order]]) < most]
        ends = np.append(word, len(chars) - 1)
        for w in order.tolist():
            if end[w] > begin[w]:
                out.append(chars[word[begin[w]] : ends[end[w]]].tobytes().decode("utf-32-le"))
                number.append(done + int(text[w]))
        top.append(np.maximum.reduceat(logit, first[:-1]))
        done += len(first) - 1
    return out, np.array(number, np.int64), np.concatenate(top)


#: cut(model, which, most): windows of the numbered texts, all of them for None, as `_cut` has them.
Cut = Callable[[ToxicityModel, np.ndarray | None, int], tuple[list[str], np.ndarray, np.ndarray]]


def fit(labels: np.ndarray, cut: Cut) -> ToxicityModel:
    """Trains on all windows of a few hundred texts, then on the highest-scoring windows of all,
    chosen anew between rounds of steps."""
    if len(set(labels.tolist())) < 2:
        return ToxicityModel(np.zeros(BUCKETS), 4.0 if len(labels) and labels[0] else -4.0)
    trainer = _Trainer()
    few = np.sort(np.concatenate([np.flatnonzero(labels == y)[:START_TEXTS] for y in (0, 1)]))
    windows, text, _ = cut(trainer.model(), few, 10**9)
    trainer.run(windows, text, labels[few], 16)
    for rounds in (12, 12, 12):
        windows, text, _ = cut(trainer.model(), None, 4)
        trainer.run(windows, text, labels, rounds)
    model = trainer.model()
    # The bias in the middle of the gap, where the fewest texts of the sample are on the wrong side.
    top = cut(model, None, 1)[2]
    order = np.argsort(top, kind="stable")
    clean = np.sum(labels == 0)
    wrong = np.concatenate(([clean], clean + np.cumsum(np.where(labels[order] == 1, 1, -1))))
    best = np.flatnonzero(wrong == wrong.min())
    at = int(best[len(best) // 2])
    edges = np.concatenate(([top[order[0]] - 1], (top[order][1:] + top[order][:-1]) / 2, [top[order[-1]] + 1]))
    return ToxicityModel(model.pull, float(model.bias - edges[at]))


def cut_on_executors(texts: DataFrame, keys: list) -> Cut:
    """Cuts a written table of texts by their keys, which are unique; the texts are numbered in the
    order of `keys`. Only windows come to the driver."""
    schema = T.StructType([texts.schema["key"], *T.StructType.fromDDL("windows array<string>, top double").fields])

    def cut(model: ToxicityModel, which: np.ndarray | None, most: int) -> tuple[list[str], np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                # One text at a time: sums of a batch would round by what else is in it.
                for b in by_size(whole, 2_000_000):
                    each = [_cut(model, [t], most) for t in b.column(1).to_pylist()]
                    lists, top = pa.array([w for w, _, _ in each], pa.list_(pa.string())), np.array([t[0] for _, _, t in each], np.float64)
                    yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(top)], schema.fieldNames())

        wanted = keys if which is None else [keys[i] for i in which.tolist()]
        some = texts if which is None else texts.where(F.col("key").isin(wanted))
        found = {r["key"]: r for r in some.select("key", "text").mapInArrow(run, schema).collect()}
        rows = [found[k] for k in wanted]
        return [w for r in rows for w in r["windows"]], np.repeat(np.arange(len(rows)), [len(r["windows"]) for r in rows]), np.array([r["top"] for r in rows])

    return cut


def train(docs: DataFrame, labels: DataFrame, learn: Column, *, key: str = "doc_id", text: str = "text", label: str = "toxic", toxic: int = TRAIN_TOXIC, clean: int = TRAIN_CLEAN) -> ToxicityModel:
    """Fits on about `toxic` and `clean` of the labelled keys where `learn`, a condition on the
    key, holds, drawn by a hash of the key, twice as many at most; their texts are cut on the
    executors. Of rows that share a key the one whose text has the least hash is used. Rows without
    text or label are not used; keys labelled twice count as toxic if one label is 1."""
    known = labels.select(labels[key].alias("key"), F.col(label).alias("y")).where(F.col("key").isNotNull() & F.col("y").isNotNull())
    known = known.withColumnRenamed("key", key).where(learn).groupBy(key).agg(F.max("y").alias("y"))
    counts = {int(r["y"]): r["n"] for r in known.where(F.col("y").isin(0, 1)).groupBy("y").agg(F.count("*").alias("n")).collect()}
    rank = F.xxhash64(F.lit("toxicity"), F.col(key))
    draw = F.pmod(rank, F.lit(1_000_000)) / 1e6
    keep = F.coalesce(*(F.when(F.col("y") == y, draw < most / counts[y]) for y, most in ((1, toxic), (0, clean)) if counts.get(y)), F.lit(False))
    drawn = F.broadcast(known.where(keep).orderBy(rank).limit(2 * (toxic + clean)))
    found = docs.select(docs[key], docs[text].cast("string").alias("text")).where(F.col("text").isNotNull()).join(drawn, key)
    found = found.groupBy(F.col(key).alias("key"), "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    steps = Steps(docs.sparkSession)
    found = steps.saved(found, "labelled")
    # A key and a label a row, as many as are drawn.
    rows = sorted((r["key"], int(r["y"] == 1)) for r in found.select("key", "y").collect())
    model = fit(np.array([y for _, y in rows], np.int64), cut_on_executors(found, [k for k, _ in rows]))
    steps.drop(found)
    return model


def score(docs: DataFrame, model: ToxicityModel, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, score), one for each row of `docs`, repeated ones too, from whole texts; null and
    empty texts and texts without a word get the score of an empty window. An empty table gives no
    rows. Other columns are not read, whatever their names; keys may be null."""
    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_size(whole):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(b.column(1).to_pylist()))], ["key", "score"])

    return rows.mapInArrow(run, T.StructType([rows.schema["key"], T.StructField("score", T.DoubleType())])).withColumnRenamed("key", key)
