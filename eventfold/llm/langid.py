"""Language identification with error-correcting output codes.

Every learned language has a codeword. One binary classifier over hashed character n-grams
predicts each bit; a text gets the language whose codeword has the least loss against the
predicted bits, each bit weighed by its classifier's training accuracy. A text is flagged as
ambiguous if the next codeword is nearly as close.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chars import grams, text_groups, words_of
from .sentencepiece_codec import by_size

#: Rows that the classifiers are fitted on, over all languages.
TRAIN_ROWS = 1600
BUCKETS = 1 << 13
ORDERS = (1, 2, 3)
UNKNOWN = "und"
#: Difference in probability below which the two nearest codewords leave a text ambiguous.
MARGIN = 0.2
#: A text is in no learned language if its loss is so many times that of any row trained on,
#: unless it has fewer characters.
SLACK, SHORT = 1.35, 40


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Root of the relative frequency of each n-gram bucket, and whether there is a letter."""
    chars, starts = words_of(texts)
    hashed = [grams(chars, n, BUCKETS) for n in ORDERS]
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for i, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
        found = np.bincount(np.concatenate([h[a : max(a, b - n + 1)] for n, h in zip(ORDERS, hashed, strict=True)]), minlength=BUCKETS)
        out[i] = np.sqrt(found / max(1, found.sum()))
    return out, np.diff(starts) > 1


def codewords(n: int) -> np.ndarray:
    """n codewords of +-1: all splits of up to five languages, else the best of random codes."""
    if n <= 1:
        return np.ones((n, 1), np.float32)
    if n <= 5:
        rows = (np.arange(1, 2 ** (n - 1))[:, None] >> np.arange(n)) & 1
        return (2.0 * rows.T - 1).astype(np.float32)
    bits, rng, best = int(np.ceil(10 * np.log2(n))), np.random.default_rng(8), (-1, None)
    for _ in range(100):
        code = rng.choice([-1.0, 1.0], (n, bits)).astype(np.float32)
        code = code[:, np.abs(code.sum(0)) < n]
        apart = ((code.shape[1] - code @ code.T) / 2 + np.eye(n) * bits).min()
        best = max(best, (apart, code), key=lambda x: x[0])
    return best[1]


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # BUCKETS + 1 rows, the last is the bias
    trust: np.ndarray
    bound: float = np.inf  # loss of the nearest codeword beyond which a text is in no learned language

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Loss of each row against each codeword."""
        margin = (x @ self.weights[:-1] + self.weights[-1])[:, None, :] * self.code
        return (np.logaddexp(0, -margin) * self.trust).sum(2)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores in 0..1, and whether a text is ambiguous."""
        langs, scores, unsure = [], [], []
        for x, letters, _ in self._features(texts):
            if not self.languages:
                letters = np.zeros(len(x), bool)
                p = np.ones((len(x), 1))
            else:
                loss = self.losses(x)
                p = np.exp(loss.min(1, keepdims=True) - loss)
                p /= p.sum(1, keepdims=True)
            first = p.argmax(1)
            top = np.sort(p, 1)
            langs += [self.languages[k] if ok else UNKNOWN for k, ok in zip(first.tolist(), letters.tolist(), strict=True)]
            scores.append(np.where(letters, top[:, -1], 0.0))
            unsure.append(letters & (top[:, -1] - (top[:, -2] if top.shape[1] > 1 else 0) < MARGIN))
        return langs, np.concatenate([*scores, np.zeros(0)]), np.concatenate([*unsure, np.zeros(0, bool)])

    def known(self, texts: list[str | None]) -> np.ndarray:
        """Whether a text is in a learned language: it has a letter, and its bits are near enough
        to some codeword. Texts of few characters can't be told apart; a letter is enough."""
        out = [np.zeros(0, bool)]
        for x, letters, short in self._features(texts):
            out.append(letters & (short | (self.losses(x).min(1) <= self.bound)) if self.languages else letters)
        return np.concatenate(out)

    @staticmethod
    def _features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for part in text_groups(np.fromiter((len(t or "") + 2000 for t in texts), np.int64, len(texts))):
            x, letters = features(texts[part])
            yield x, letters, np.array([len(t or "") < SHORT for t in texts[part]], bool)


def train(docs: DataFrame, learn: Column, *, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> LanguageModel:
    """Fits the bit classifiers on about `rows` of the rows where `learn` holds and language and
    text are not null, drawn evenly over the languages by a hash of key and text; equal rows
    count once, and each language gives twice its share at most. Features are made on the
    executors from whole texts. Languages are listed on the driver, a row for each."""
    known = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[lang]: r["n"] for r in known.groupBy(lang).agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], codewords(0), np.zeros((BUCKETS + 1, 1), np.float32), np.ones(1))
    share = max(1, rows // len(languages))
    rank = F.xxhash64(F.lit("language"), F.col(key), F.col(text))
    draw = F.pmod(rank, F.lit(1_000_000)) / 1e6
    keep = F.coalesce(*(F.when(F.col(lang) == name, draw < share / counts[name]) for name in languages), F.lit(False))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_size(whole, 2_000_000):
                x, _ = features(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], ["lang", "x"])

    drawn = known.where(keep).select(F.col(lang).alias("lang"), F.col(text).alias("text"), rank.alias("rank"))
    drawn = drawn.groupBy("lang", "rank").agg(F.any_value("text").alias("text"))
    drawn = drawn.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("rank"))).where(F.col("nth") <= 2 * share).select("lang", "text")
    found = drawn.mapInArrow(make, "lang string, x binary").collect()
    found.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    x = np.stack([np.frombuffer(bytes(r["x"]), np.float16) for r in found]).astype(np.float32) if found else np.zeros((0, BUCKETS), np.float32)
    y = np.array([languages.index(r["lang"]) for r in found], np.int64)
    code = codewords(len(languages))
    want = code[y]
    w = np.zeros((BUCKETS + 1, code.shape[1]), np.float32)
    speed = np.full_like(w, 1e-6)
    for _ in range(60):  # full-batch logistic regression, steps as in Adagrad
        margin = want * (x @ w[:-1] + w[-1])
        pull = -want / (1 + np.exp(np.clip(margin, -30, 30))) / max(1, len(y))
        slope = np.vstack([x.T @ pull, pull.sum(0, keepdims=True)]) + 1e-6 * w
        speed += slope * slope
        w -= 1.0 * slope / np.sqrt(speed)
    right = (want * (x @ w[:-1] + w[-1]) > 0).mean(0) if len(y) else np.ones(code.shape[1])
    model = LanguageModel(languages, code, w, np.clip(2 * right - 1, 0.05, 1))
    if len(y):
        model.bound = SLACK * float(model.losses(x).min(1).max())
    return model


def identify(docs: DataFrame, model: LanguageModel, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, lang_pred, score, ambiguous), one for each row of `docs`, from whole texts.

    `lang_pred` is a learned language, or `und` with score 0 if the text is null, empty or
    without a letter, or if no language was learned. Of languages equally near the first by name is
    taken. Repeated rows give a row each, an empty table none. Other columns are not read, whatever
    their names; keys may be null.
    """
    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_size(whole):
                langs, score, unsure = model.predict(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(score.astype(np.float64)), pa.array(unsure)], ["key", "lang_pred", "score", "ambiguous"])

    schema = T.StructType([rows.schema["key"], *T.StructType.fromDDL("lang_pred string, score double, ambiguous boolean").fields])
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
