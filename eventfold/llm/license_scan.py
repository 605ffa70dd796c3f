"""Fuzzy search for short licence notices.

A notice may occur with up to k edits. Cut into k + m pieces, at least m of them then occur
unchanged: one Aho-Corasick pass finds the pieces of all notices, and only where enough of them
stand in line the regex library matches the notice with at most k errors, which gives span and
errors.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .sentencepiece_codec import by_size


@dataclass(frozen=True)
class Notice:
    """`words` in lower case with single spaces; k = 0 asks for the words themselves, whole."""

    label: str
    words: str
    k: int = 0


#: Places of these words, standing consecutively, are base places.
BASE = (Notice("cc-by", "cc by"), Notice("gpl", "general public license"), Notice("reserved", "all rights reserved"))
#: Opening or closing words of common licences, and the edits that are allowed.
NOTICES = (
    Notice("agpl", "gnu affero general public license", 4),
    Notice("apache-2.0", "licensed under the apache license version 2 0", 4),
    Notice("apache-2.0", "apache license version 2 0", 3),
    Notice("artistic", "the artistic license 2 0", 3),
    Notice("boost", "boost software license version 1 0", 4),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("bsd", "neither the name of the copyright holder nor the names of its contributors", 6),
    Notice("cc-by", "creative commons attribution", 3),
    Notice("cc-by", "licensed under a creative commons license", 4),
    Notice("cc-by-nc", "creative commons attribution noncommercial", 4),
    Notice("cc-by-sa", "creative commons attribution sharealike", 4),
    Notice("cc0", "to the extent possible under law the person has waived all copyright", 6),
    Notice("cc0", "cc0 1 0 universal", 1),
    Notice("copyright", "this work is protected by copyright", 3),
    Notice("epl", "eclipse public license", 2),
    Notice("eupl", "european union public licence", 3),
    Notice("gfdl", "gnu free documentation license", 3),
    Notice("gpl", "gnu general public license", 3),
    Notice("gpl", "under the terms of the gnu general public license", 5),
    Notice("isc", "permission to use copy modify and or distribute this software", 5),
    Notice("lgpl", "gnu lesser general public license", 4),
    Notice("lgpl", "gnu library general public license", 4),
    Notice("mit", "permission is hereby granted free of charge to any person", 5),
    Notice("mit", "released under the mit license", 3),
    Notice("mit", "licensed under the mit license", 3),
    Notice("mpl", "mozilla public license", 2),
    Notice("ofl", "sil open font license", 2),
    Notice("public-domain", "released into the public domain", 3),
    Notice("reserved", "all rights reserved", 2),
    Notice("reserved", "no part of this publication may be reproduced", 4),
    Notice("unlicense", "this is free and unencumbered software", 4),
    Notice("warranty", "the software is provided as is without warranty of any kind", 5),
    Notice("zlib", "this software is provided as is without any express or implied warranty", 6),
)

_BLANKED = bytes(c if c >= 0x80 or chr(c).isalnum() else 32 for c in range(256))


def plain(text: str | None) -> str:
    """The text's words, A-Z in lower case, each with one space around: ' word word '."""
    words = (text or "").encode().lower().translate(_BLANKED).split()
    return f" {b' '.join(words).decode()} " if words else " "


#: Characters of a seed, at least, and windows whose matches a task remembers.
SEED, KNOWN = 4, 10_000


class Scanner:
    """Finds notices with at most their number of edits.

    A notice is cut into more pieces than edits can touch, so a match keeps some of them whole, at
    places that differ from the notice's own by no more than the edits. Only where that many
    different pieces stand so is the text matched, and nothing but that window of it.
    """

    def __init__(self, base: tuple[Notice, ...] = BASE, notices: tuple[Notice, ...] = NOTICES):
        import ahocorasick
        import regex

        self.notices = [*base, *notices]
        self.base = len(base)
        self.patterns, self.needed, seeds = [], [], {}
        for i, notice in enumerate(self.notices):
            whole = f" {notice.words} " if notice.k == 0 else notice.words
            self.patterns.append((whole, regex.compile(f"(?b)(?:{regex.escape(whole, literal_spaces=True)}){{e<={notice.k}}}")))
            parts = 1 if notice.k == 0 else max(notice.k + 1, min(notice.k + 3, len(whole) // SEED))
            self.needed.append(parts - notice.k)
            cuts = [j * len(whole) // parts for j in range(parts + 1)]
            for j, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                seeds.setdefault(whole[a:b], []).append((i, j, a))
        self.known: dict[tuple[int, str], tuple[int, int, int]] = {}
        self.seeds = ahocorasick.Automaton()
        for seed, of in seeds.items():
            self.seeds.add_word(seed, (len(seed), of))
        self.seeds.make_automaton()

    def matches(self, words: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, errors) in the plain text, in order of notice and start.

        Of one notice with k > 0 the match with the fewest errors comes first, the leftmost of
        these, then what is found beside it; those with k = 0 are all places.
        """
        found: dict[int, list[tuple[int, int]]] = {}
        for end, (size, of) in self.seeds.iter(words):
            for i, piece, at in of:
                found.setdefault(i, []).append((end - size + 1 - at, piece))
        out = []
        for i in sorted(found):
            if self.notices[i].k == 0:
                out += [(i, at, at + len(self.patterns[i][0]), 0) for at, _ in found[i]]
            else:
                out += [(i, *span) for span in self._spans(i, words, found[i])]
        return out

    def _windows(self, i: int, hits: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
        """Where enough different pieces stand within k characters of one place of the notice."""
        k, length, needed = self.notices[i].k, len(self.patterns[i][0]), self.needed[i]
        hits = sorted(set(hits))
        out, count, last = [], {}, 0
        for at, piece in hits:
            while last < len(hits) and hits[last][0] <= at + k:
                count[hits[last][1]] = count.get(hits[last][1], 0) + 1
                last += 1
            if len(count) >= needed:
                a, b = max(0, at - k), min(size, at + length + 2 * k)
                if out and a - out[-1][0] <= k:
                    out[-1] = out[-1][0], b
                else:
                    out.append((a, b))
            count[piece] -= 1
            if not count[piece]:
                del count[piece]
        return out

    def _best(self, i: int, window: str) -> tuple[int, int, int]:
        """(errors, start, end) of the best match in a window, errors -1 if there is none; repeated
        windows are matched once."""
        if (found := self.known.get((i, window))) is None:
            m = self.patterns[i][1].search(window)
            found = (sum(m.fuzzy_counts), m.start(), m.end()) if m else (-1, 0, 0)
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[i, window] = found
        return found

    def _spans(self, i: int, words: str, hits: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        whole, k = self.patterns[i][0], self.notices[i].k
        windows = self._windows(i, hits, len(words))
        taken: list[tuple[int, int, int]] = []
        at = words.find(whole) if windows else -1
        while at >= 0:  # without errors none is better
            taken.append((at, at + len(whole), 0))
            at = words.find(whole, at + len(whole))
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(window: tuple[int, int], among: list[tuple[int, int, int]]) -> None:
            for a, b in _without(window, among, len(whole) - k):
                errors, start, stop = self._best(i, words[a:b])
                if errors >= 0:
                    heapq.heappush(agenda, (errors, a + start, a + stop, a, b))

        for window in windows:
            offer(window, taken)
        while agenda:
            errors, start, stop, *window = heapq.heappop(agenda)
            at = bisect.bisect_left(taken, (start, start, 0))
            if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or taken[at][0] >= stop):
                taken.insert(at, (start, stop, errors))
            offer(tuple(window), taken)  # what lies beside the matches taken may hold another one
        return taken


def _without(window: tuple[int, int], spans: list[tuple[int, int, int]], least: int) -> list[tuple[int, int]]:
    """The parts of a window of `least` characters or more beside these spans, which are in order."""
    a, b = window
    out, first = [], max(0, bisect.bisect_left(spans, (a, a, 0)) - 1)
    for start, stop, _ in spans[first:]:
        if start >= b:
            break
        if stop > a:
            if start - a >= least:
                out.append((a, start))
            a = max(a, stop)
    if b - a >= least:
        out.append((a, b))
    return out


MATCH = "label string, base boolean, first_word long, n_words long, errors int, likeness double"


def scan(docs: DataFrame, *, base: tuple[Notice, ...] = BASE, notices: tuple[Notice, ...] = NOTICES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_words, matches), one for each row of `docs`, from whole texts.

    A match has the notice's label, whether it is a base place, the number of its first word
    (from 0), how many words it touches, its edits, and 1 minus edits by length. Null and
    empty texts have no words and no matches. Repeated rows are kept; an empty table gives no rows.
    Of matches with equal errors the first is taken. Other columns are not read, whatever their names.
    """
    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    schema = T.StructType([rows.schema["key"], T.StructField("n_words", T.LongType()), T.StructField("matches", T.ArrayType(T.StructType.fromDDL(MATCH)))])
    arrow = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("errors", pa.int32()), ("likeness", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = None
        for whole in batches:
            scanner = scanner or Scanner(base, notices)
            for b in by_size(whole):
                counts, found = [], []
                for t in b.column(1).to_pylist():
                    words = plain(t)
                    counts.append(max(0, words.count(" ") - 1))
                    hits, at, before, places = scanner.matches(words), 0, 0, {}
                    for start in sorted({s for _, s, _, _ in hits}):  # words before each start, counted once through the text
                        before += words.count(" ", at, start + 1)
                        at = start + 1
                        places[start] = before - 1
                    rows_ = []
                    for i, s, e, errors in hits:
                        notice, inner = scanner.notices[i], words[s:e].strip(" ")
                        first = places[s]
                        rows_.append({"label": notice.label, "base": i < scanner.base, "first_word": first, "n_words": inner.count(" ") + 1, "errors": errors, "likeness": 1 - errors / len(notice.words)})
                    found.append(rows_)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(found, arrow)], schema.names)

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
