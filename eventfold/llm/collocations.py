"""Phrase collocations by level-wise passes over coded texts.

A first pass counts words; the frequent ones of each language get numbers, and texts are kept as
sequences of numbers in which a zero stands for anything that no frequent phrase crosses. A place
holds the number of the frequent k-gram that begins there. So a (k+1)-gram can be frequent only
where two neighbouring places are not zero, and these two numbers name it exactly. Each pass counts
such pairs, numbers those that are frequent and writes them over the places, until phrases have
their full length. Scores come from the level tables alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .byte_words import PHRASES, cut
from .common import Steps, ranked, small_batches
from .sentencepiece_codec import by_size

LEAST, LONGEST, DEEPEST = 100, 5, 2000
#: A phrase is dropped inside a longer one that is found in so many per cent of its places.
COVERED = 100
UNKNOWN = "und"
#: Frequent phrases that are broadcast together, 24 bytes each at most; more go in several passes.
SLICE = 1_000_000
#: Bytes of text cut together; distinct words, and places, that a task adds up before it tells them.
TOGETHER, HELD_WORDS, HELD_PLACES = 2_000_000, 100_000, 2_000_000
#: Places of a row of coded text, about.
ROW = 250_000


def _langs(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def count_words(rows: DataFrame) -> DataFrame:
    """Rows (lang, word, n) of rows (lang, text); the row of a null word has the language's total."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bytes | None], int] = {}

        def told() -> pa.RecordBatch:
            langs, words = [k[0] for k in held], [k[1] for k in held]
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()), pa.array(held.values(), pa.int64())], ["lang", "word", "n"])

        for whole in batches:
            for b in by_size(whole, TOGETHER):
                words, text, _, _ = cut(b.column(1).to_pylist(), PHRASES)
                lang, names = _langs(b.column(0))
                spelled = words.dictionary.to_pylist()
                found, n = np.unique(lang[text] * max(1, len(spelled)) + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
                for at, times in zip(found.tolist(), n.tolist(), strict=True):
                    named = names[at // len(spelled)], spelled[at % len(spelled)]
                    held[named] = held.get(named, 0) + times
                for name, times in zip(names, np.bincount(lang[text], minlength=len(names)).tolist(), strict=True):
                    held[name, None] = held.get((name, None), 0) + times
                if len(held) > HELD_WORDS:
                    yield told()
                    held.clear()
        if held:
            yield told()

    return rows.mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _digest(lang: str, word: bytes) -> bytes:
    """Names a word of a language in a broadcast table: 16 bytes, whatever its length."""
    return hashlib.md5(lang.encode() + b"\0" + word).digest()


def _packed(sequences: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Sequences without what can't be part of a longer phrase: places with a zero on either side,
    and all but one of the zeros in a row. Long ones are cut where a zero stands."""
    for s in sequences:
        edged = np.concatenate(([0], s, [0])).astype(np.int32)
        there = edged > 0
        there[1:-1] &= (edged[:-2] > 0) | (edged[2:] > 0)
        edged[~there] = 0
        kept = edged[there | np.concatenate(([False], there[:-1]))]
        zeros = np.flatnonzero(kept == 0)
        ends = np.unique(zeros[np.searchsorted(zeros, np.arange(ROW, len(kept), ROW)).clip(max=len(zeros) - 1)]) if len(kept) > ROW else []
        for row in np.split(kept, ends):
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(([0], row)).astype(np.int32).tobytes()], pa.binary())], ["places"])


def _slices(level: DataFrame, columns: list[str]) -> Iterator[list[np.ndarray]]:
    """The columns of a level table, ordered by its ids, SLICE rows at a time."""
    total = level.count()
    for begin in range(0, max(1, total), SLICE):
        part = level.where((F.col("id") > begin) & (F.col("id") <= begin + SLICE)).select("id", *columns).toArrow()
        order = np.argsort(part.column("id").to_numpy())
        yield [part.column(c).take(pa.array(order)) for c in ["id", *columns]]


def code_words(rows: DataFrame, level: DataFrame, steps: Steps) -> DataFrame:
    """Rows (places binary): texts as numbers of their frequent words, a zero between pieces."""
    spark, done = rows.sparkSession, rows.withColumn("places", F.lit(None).cast("binary"))
    slices = list(range(max(1, -(-level.count() // SLICE))))
    for nth, (ids, digests) in zip(slices, _slices(level, ["digest"]), strict=True):
        digests, ids = np.array(digests.to_pylist(), "S16"), ids.to_numpy()
        order = np.argsort(digests)
        known = spark.sparkContext.broadcast((np.append(digests[order], b"\xff" * 16), np.append(ids[order], 0)))
        last = nth == slices[-1]

        def run(batches: Iterator[pa.RecordBatch], known=known, last=last) -> Iterator[pa.RecordBatch]:
            keys, numbers = known.value
            for whole in batches:
                for b in by_size(whole.select([0, 1, 2]), TOGETHER):
                    words, text, first, counts = cut(b.column(1).to_pylist(), PHRASES)
                    lang, names = _langs(b.column(0))
                    spelled = words.dictionary.to_pylist()
                    pairs, which = np.unique(lang[text] * max(1, len(spelled)) + words.indices.to_numpy(zero_copy_only=False), return_inverse=True)
                    named = np.array([_digest(names[p // len(spelled)], spelled[p % len(spelled)]) for p in pairs.tolist()], "S16")
                    found = np.minimum(np.searchsorted(keys, named), len(keys) - 1)
                    coded = np.where(keys[found] == named, numbers[found], 0).astype(np.int32)
                    # A zero goes before each piece; its words follow.
                    at = np.arange(len(text)) + np.cumsum(first)
                    places = np.zeros(len(text) + int(first.sum()), np.int32)
                    places[at] = coded[which] if len(pairs) else 0
                    pieces = np.bincount(text[first], minlength=len(counts))
                    ends = np.cumsum(counts + pieces)
                    each = np.split(places, ends[:-1])
                    before = b.column(2).to_pylist()
                    each = [s if x is None else s | np.frombuffer(x, np.int32) for s, x in zip(each, before, strict=True)]
                    if last:
                        yield from _packed(iter([np.concatenate([*each, [0]])]))
                    else:
                        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([s.tobytes() for s in each], pa.binary())], ["lang", "text", "places"])

        made = done.mapInArrow(run, "places binary" if last else "lang string, text string, places binary")
        before, done = done, steps.saved(made, "places")
        steps.drop(before)
        known.destroy()
    return done


def _pairs(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where two neighbouring places are numbers, and both as one."""
    at = np.flatnonzero((s[:-1] > 0) & (s[1:] > 0))
    return at, s[at].astype(np.int64) << 32 | s[at + 1]


def count_pairs(places: DataFrame) -> DataFrame:
    """Rows (pair, n) of neighbouring numbers, added up in each task before they are shuffled."""

    def told(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        pair, n = np.unique(np.concatenate(held), return_counts=True)
        for k in range(0, len(pair), ROW):
            yield pa.RecordBatch.from_arrays([pa.array(pair[k : k + ROW]), pa.array(n[k : k + ROW])], ["pair", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for b in batches:
            for x in b.column(0).to_pylist():
                _, pairs = _pairs(np.frombuffer(x, np.int32))
                held.append(pairs)
                count += len(pairs)
                if count > HELD_PLACES:
                    yield from told(held)
                    held, count = [], 0
        if count:
            yield from told(held)

    return places.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def code_pairs(places: DataFrame, level: DataFrame, steps: Steps) -> DataFrame:
    """The places of the next level: the number of the frequent pair that begins at each."""
    spark, done = places.sparkSession, places.withColumn("made", F.lit(None).cast("binary"))
    slices = list(range(max(1, -(-level.count() // SLICE))))
    for nth, (ids, pairs) in zip(slices, _slices(level, ["pair"]), strict=True):
        pairs, ids = pairs.to_numpy(), ids.to_numpy()
        order = np.argsort(pairs)
        known = spark.sparkContext.broadcast((np.append(pairs[order], np.int64(2**63 - 1)), np.append(ids[order], 0)))
        last = nth == slices[-1]

        def run(batches: Iterator[pa.RecordBatch], known=known, last=last) -> Iterator[pa.RecordBatch]:
            keys, numbers = known.value
            for b in batches:
                for old, new in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    s = np.frombuffer(old, np.int32)
                    out = np.zeros(len(s), np.int32) if new is None else np.frombuffer(new, np.int32).copy()
                    at, pair = _pairs(s)
                    found = np.searchsorted(keys, pair)
                    hit = keys[found] == pair
                    out[at[hit]] = numbers[found[hit]]
                    if last:
                        yield from _packed(iter([out]))
                    else:
                        yield pa.RecordBatch.from_arrays([pa.array([old], pa.binary()), pa.array([out.tobytes()], pa.binary())], ["places", "made"])

        made = done.mapInArrow(run, "places binary" if last else "places binary, made binary")
        before, done = done, steps.saved(made, "places")
        steps.drop(before)
        known.destroy()
    return done


def levels(docs: DataFrame, steps: Steps, *, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, list[DataFrame]]:
    """Totals (lang, total), and for each length a table (id, lang, phrase, n, heads, tails, left,
    right): a frequent phrase, the counts of its beginnings and of its ends from one word on, and
    the ids of the phrases without its last and without its first word."""
    rows = docs.select(F.coalesce(docs[lang].cast("string"), F.lit(UNKNOWN)).alias("lang"), docs[text].cast("string").alias("text"))
    counts = steps.saved(count_words(rows).where((F.col("n") >= least) | F.col("word").isNull()), "words")
    totals = counts.where("word is null").select("lang", F.col("n").alias("total"))
    none = F.array().cast("array<bigint>")
    digest = F.unhex(F.md5(F.concat(F.col("lang").cast("binary"), F.lit(b"\0"), F.col("word"))))
    words = ranked(counts.where("word is not null"), [F.col("lang"), F.col("word")], "id", steps)
    made = words.select("id", "lang", F.col("word").cast("string").alias("phrase"), "n", none.alias("heads"), none.alias("tails"), F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("right"), digest.alias("digest"))
    tables = [steps.saved(made, "level")]
    places = code_words(rows, tables[0], steps)
    for _ in range(longest - 1):
        found = steps.saved(count_pairs(places).where(F.col("n") >= least), "pairs")
        if found.isEmpty():
            break
        found = ranked(found, [F.col("pair")], "id", steps)
        found = found.withColumns({"left": F.shiftright("pair", 32), "right": F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))})
        last = tables[-1]
        head = last.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("begun"), F.array_append("heads", F.col("n")).alias("heads"))
        tail = last.select(F.col("id").alias("right"), F.substring_index("phrase", " ", -1).alias("word"), F.array_append("tails", F.col("n")).alias("tails"))
        table = found.join(head, "left").join(tail, "right").select("id", "lang", F.concat_ws(" ", "begun", "word").alias("phrase"), "n", "heads", "tails", "left", "right", "pair")
        tables.append(steps.saved(table, "level"))
        if len(tables) < longest:
            last_places, places = places, code_pairs(places, tables[-1], steps)
            steps.drop(last_places)
    steps.drop(places)
    return totals, tables


def lowest_cut(total: Column) -> Column:
    """Struct (score, cut, l, r) of the lowest-scoring cut; ties go to the earlier one."""
    wide = lambda c: c.cast("decimal(19,0)")
    whole = lambda a, b: F.call_function("div", a, b)

    def scored(k: Column) -> Column:
        left, right = F.get(F.col("heads"), k), F.get(F.col("tails"), F.size("heads") - 1 - k)
        score = whole(wide(F.col("n")) * wide(total) * F.lit(1000).cast("decimal(4,0)"), wide(left) * wide(right))
        return F.struct(score.alias("score"), (k + 1).alias("cut"), left.alias("l"), right.alias("r"))

    return F.array_min(F.transform(F.sequence(F.lit(0), F.size("heads") - 1), scored))


def mine(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, covered: int = COVERED, deepest: int = DEEPEST) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score) of each language's `deepest` best phrases of two
    to `longest` words that stand `least` times or more within pieces of texts.

    A phrase that stands inside a longer frequent one in `covered` per cent of its places or more is
    dropped; as frequency only falls with length, one word more on either side tells. Null languages
    count as `und`, null texts as empty. Repeated rows count as often as they occur. A table without
    frequent phrases, or an empty one, gives no rows. Other columns are not read.
    """
    steps = Steps(docs.sparkSession)
    with small_batches(docs.sparkSession):
        totals, tables = levels(docs, steps, text=text, lang=lang, least=least, longest=longest)
    found = None
    for k, table in enumerate(tables[1:], 1):
        if k + 1 < len(tables):
            longer = tables[k + 1].select(F.explode(F.array("left", "right")).alias("id"), F.col("n").alias("more")).groupBy("id").agg(F.max("more").alias("more"))
            table = table.join(longer, "id", "left").where(F.col("more").isNull() | (F.col("more") * 100 < F.col("n") * covered))
        table = table.select("lang", "phrase", "n", "heads", "tails")
        found = table if found is None else found.unionByName(table)
    if found is None:
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    best = lowest_cut(F.col("total"))
    scored = found.join(totals, "lang").withColumn("best", best).select("lang", "phrase", F.col("n").alias("a"), "best.l", "best.r", F.col("total").alias("n"), F.col("best.score").cast("long").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The best of parts of a language first, so that no task ranks all of one.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    some = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= deepest)
    placed = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= deepest)
    return placed.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
