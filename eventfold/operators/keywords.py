"""A trigram index for keywords: which events have each run of three characters in a searched field.

A keyword's events are among those that have all of its runs; only these are looked through. Lists
are kept in chunks of 65,536 event ids, so none grows with the corpus, and lie in the order of
their runs, so that a keyword reads the few files and row groups that hold its own. Texts come in the
order of their events, so that a task lists its own events' runs and little is left to be joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import or_empty
from ..sources.store import Scratch
from .library import NAMED, SEARCHED

RUN, CHUNK = 3, 16
#: Bytes of text that a task lists at once, about; a longer text is listed alone.
SLICE = 1 << 21
#: Words that are looked up at once, a bit each, and runs of theirs whose lists a task holds at once.
MOST_WORDS, MOST_RUNS = 60, 200
#: Candidates whose ids are given to the scan, and those that are broadcast, at most.
LISTED, BROADCAST = 1_000, 100_000


def _texts(columns: Iterable[str], of=F.lower) -> Column:
    return F.array(*(of(F.col(c).cast("string")) for c in columns))


def _lister(most: int = SLICE) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What tasks make rows (run, chunk, events) of rows (event_id, texts) with, `most` bytes at once. It
    is made here so that it goes to the workers whole; they need not have this package."""

    def listed(ids: np.ndarray, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        """Rows (run, chunk, events) of texts in lower case and their events' ids."""
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if ends[-1] == ends[0]:
            return
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        chars = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        before = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        lengths = np.diff(before[ends - ends[0]])
        known = np.zeros(int(chars.max()) + 1, bool)
        known[chars] = True
        letters, events = np.flatnonzero(known), np.unique(ids)
        wide, low = max(1, (len(letters) - 1).bit_length()), (len(events) - 1).bit_length()
        if RUN * wide + low > 63:  # too many characters for one number a run and event
            half = events[len(events) // 2]
            for some in (ids < half, ids >= half):
                yield from listed(ids[some], texts.filter(pa.array(some)))
            return
        place = np.zeros(len(known), np.int64)
        place[letters] = np.arange(len(letters))
        code, text = place[chars], np.repeat(np.arange(len(ids)), lengths)
        within = np.flatnonzero(text[: 1 - RUN] == text[RUN - 1 :])
        both = np.zeros(len(within), np.int64)
        for k in range(RUN):
            both = (both << wide) | code[within + k]
        both = (both << low) | np.searchsorted(events, ids)[text[within]]
        both.sort()
        both = both[np.concatenate((both[:1] == both[:1], both[1:] != both[:-1]))]
        run, event = both >> low, events[both & ((1 << low) - 1)]
        chunk = event >> CHUNK
        first = np.flatnonzero(np.concatenate((run[:1] == run[:1], (run[1:] != run[:-1]) | (chunk[1:] != chunk[:-1]))))
        spelled = np.stack([letters[(run[first] >> (wide * k)) & ((1 << wide) - 1)] for k in range(RUN - 1, -1, -1)], axis=1)
        spelled = spelled.astype("<u4").tobytes().decode("utf-32-le")
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(both)), pa.int32()), pa.array(event & ((1 << CHUNK) - 1), pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array([spelled[k : k + RUN] for k in range(0, len(spelled), RUN)], pa.string()), pa.array(chunk[first], pa.int64()), lists], ["run", "chunk", "events"])

    def lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (run, chunk, events) of rows (event_id, texts), slice by slice."""
        kept, size = [], 0

        def taken() -> Iterator[pa.RecordBatch]:
            nonlocal kept, size
            if kept:
                yield from listed(np.concatenate([i for i, _ in kept]), pa.concat_arrays([t for _, t in kept]))
            kept, size = [], 0

        for batch in batches:
            given = batch.column("texts")
            ids, texts = np.repeat(batch.column("event_id").to_numpy(), given.value_lengths().to_numpy()), given.flatten().cast(pa.large_string())
            ends, at = np.cumsum(pc.binary_length(texts).to_numpy()), 0
            while at < len(ids):
                done = int(ends[at - 1]) if at else 0
                to = max(at + (not kept), int(np.searchsorted(ends, done + most - size, "right")))
                kept.append((ids[at:to], texts[at:to]))
                size, at = size + (int(ends[to - 1]) - done if to > at else 0), to
                if at < len(ids):
                    yield from taken()
        yield from taken()

    return lists


def build(members: DataFrame, events: DataFrame) -> DataFrame:
    """Rows (run, chunk, events) in their order: the ids' lower parts, sorted."""
    valid = lambda c: F.make_valid_utf8(F.lower(or_empty(c)))
    ordered = lambda rows, *columns: rows.select("event_id", *columns).repartitionByRange("event_id").sortWithinPartitions("event_id")
    own = ordered(members, *SEARCHED).select("event_id", _texts(SEARCHED, valid).alias("texts"))
    named = ordered(events, *NAMED, "processing_departments").select("event_id", F.concat(_texts(NAMED, valid), F.coalesce(F.transform("processing_departments", valid), F.array().cast("array<string>"))).alias("texts"))
    parts = own.unionByName(named).mapInArrow(_lister(), "run string, chunk long, events array<int>")
    found = parts.groupBy("run", "chunk").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("events")))).alias("events"))
    return found.repartitionByRange("run", "chunk").sortWithinPartitions("run", "chunk")


def _runs(word: str) -> list[str]:
    """The runs of a word by which its candidates are found; of a longer one the first MOST_RUNS."""
    return sorted({word[k : k + RUN] for k in range(len(word) - RUN + 1)})[:MOST_RUNS]


def asked(index: DataFrame, words: dict[int, str]) -> DataFrame:
    """Rows (event_id, asked) of the events that have all `_runs` of some of the words, whose bits are
    in `asked`. Each word has a run. A task sees the words' lists of one chunk at a time."""
    wanted = {k: _runs(w) for k, w in words.items()}

    def of_chunk(key, table):
        lists = dict(zip(table.column("run").to_pylist(), table.column("events").combine_chunks(), strict=True))
        marks = np.zeros(1 << CHUNK, np.int64)
        for k, runs in wanted.items():
            if all(r in lists for r in runs):
                n = np.zeros(1 << CHUNK, np.int32)
                for r in runs:
                    n[lists[r].values.to_numpy()] += 1
                marks[n == len(runs)] |= 1 << k
        low = np.flatnonzero(marks)
        return pa.table({"event_id": (key[0].as_py() << CHUNK) + low, "asked": marks[low]})

    some = index.where(F.col("run").isin(sorted(set().union(*wanted.values()))))
    return some.groupBy("chunk").applyInArrow(of_chunk, "event_id long, asked long")


def candidates(index: DataFrame, word: str) -> DataFrame | None:
    """Rows (event_id) of the events that have all runs of the word; None if it is too short."""
    return asked(index, {0: word}).select("event_id") if len(word) >= RUN else None


def among(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of these events. Few ids go to the scan, which skips what lies outside of them; more
    are joined."""
    ids = [r["event_id"] for r in found.select("event_id").distinct().limit(LISTED + 1).collect()]
    if len(ids) <= LISTED:
        return rows.where(F.col("event_id").isin(ids)) if ids else rows.limit(0)
    few = found.limit(BROADCAST + 1).count() <= BROADCAST
    return rows.join(F.broadcast(found) if few else found, "event_id", "left_semi")


def contains_any(columns: list[Column], word: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(c.cast("string")), F.lit(word)), F.lit(False))
    return out


def hits(members: DataFrame, events: DataFrame, index: DataFrame | None, word: str) -> DataFrame:
    """Rows (event_id) of the events of which a member's field, or one of its own, has the word."""
    found = None if index is None else candidates(index, word)
    own, named = (members, events) if found is None else (among(members, found), among(events, found))
    listed = F.exists("processing_departments", lambda d: F.contains(F.lower(d), F.lit(word)))
    by_member = own.where(contains_any([F.col(c) for c in SEARCHED], word)).select("event_id")
    by_event = named.where(contains_any([F.col(c) for c in NAMED], word) | listed).select("event_id")
    return by_member.union(by_event).distinct()


def _batches(words: Iterable[str]) -> Iterator[list[str]]:
    """The words in groups, none of more words or runs than are looked up at once."""
    some, runs = [], set()
    for word in words:
        more = runs | set(_runs(word))
        if some and (len(some) == MOST_WORDS or len(more) > MOST_RUNS):
            yield some
            some, more = [], set(_runs(word))
        some, runs = [*some, word], more
    if some:
        yield some


def lookup(members: DataFrame, events: DataFrame, index: DataFrame, words: Iterable[str], owner: Scratch) -> DataFrame:
    """Rows (word, event_id) of the events that have each of the words, in lower case: what `hits` finds
    of each, with the lists and the candidates' rows read once for many words."""
    found = [_marked(members, events, index, some, owner) for some in _batches(dict.fromkeys(words))]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _marked(members: DataFrame, events: DataFrame, index: DataFrame, words: list[str], owner: Scratch) -> DataFrame:
    long = {k: w for k, w in enumerate(words) if len(w) >= RUN}
    # Words without a run are looked for in every row, the others in those of their candidates.
    everywhere = sum(1 << k for k in range(len(words)) if k not in long)
    given = F.array(*(F.struct(F.lit(1 << k).cast("long").alias("bit"), F.lit(w).alias("word")) for k, w in enumerate(words)))
    # A row's texts are joined by a character that is in no word, so that none is found across two.
    apart = next(c for c in map(chr, range(1, 0xD800)) if not any(c in w for w in words))
    some = owner.staged(asked(index, long), "asked") if long else None

    def marks(rows: DataFrame, texts: Column) -> DataFrame:
        rows = rows.select("event_id", F.array_join(texts, apart).alias("text"))
        rows = rows.withColumn("asked", F.lit(0).cast("long")) if some is None else rows.join(some, "event_id", "left" if everywhere else "inner")
        rows = rows.withColumn("asked", F.coalesce("asked", F.lit(0)).bitwiseOR(F.lit(everywhere).cast("long")))
        there = F.filter(given, lambda w: (F.col("asked").bitwiseAND(w["bit"]) != 0) & F.contains("text", w["word"]))
        return rows.select("event_id", F.aggregate(there, F.lit(0).cast("long"), lambda bits, w: bits.bitwiseOR(w["bit"])).alias("found")).where("found <> 0")

    listed = F.coalesce(F.transform("processing_departments", F.lower), F.array().cast("array<string>"))
    both = marks(members, _texts(SEARCHED)).union(marks(events, F.concat(_texts(NAMED), listed)))
    each = both.groupBy("event_id").agg(F.bit_or("found").alias("found"))
    of = F.filter(given, lambda w: F.col("found").bitwiseAND(w["bit"]) != 0)
    return each.select(F.explode(F.transform(of, lambda w: w["word"])).alias("word"), "event_id")
