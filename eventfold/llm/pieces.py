"""Texts cut into pieces that a tokenizer encodes apart, in numpy and Arrow.

Where pieces begin is found for all characters of many texts at once; Arrow's hash table then
names the distinct pieces, so only these are looked at one by one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut together; longer texts are taken in parts.
TOGETHER = 2_000_000
_SAFE = re.compile(r"(?<=[!-~]) (?=[!-~])")


def as_strings(texts: list[str | None] | pa.Array) -> pa.StringArray:
    """The texts without nulls, which count as empty."""
    found = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    return pc.fill_null(found, "")


def parts_of(text: str, most: int = TOGETHER) -> list[str]:
    """A long text in parts that begin with a space between two plain characters, where pieces
    of every kind of vocabulary begin; a text without such places is one part."""
    out, at = [], 0
    while len(text) - at > most and (cut := _SAFE.search(text, at + most)):
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


class Cut:
    """Characters of texts, and from a mask of those that begin a piece, the pieces."""

    def __init__(self, texts: pa.StringArray):
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        raw = bytes(texts.buffers()[2][int(offsets[0]) : int(offsets[-1])]) if offsets[-1] > offsets[0] else b""
        offsets = (offsets - offsets[0]).astype(np.int64)
        self.chars = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        self.raw, plain = raw, len(self.chars) == len(raw)
        # Byte at which each character begins, with the total last.
        self.byte = np.arange(len(raw) + 1) if plain else np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw))
        self.starts = offsets if plain else np.searchsorted(self.byte, offsets)
        self.begins = np.zeros(len(self.chars), bool)  # first character of a text
        self.begins[self.starts[:-1][self.starts[:-1] < len(self.chars)]] = True

    def pieces(self, mask: np.ndarray) -> tuple[np.ndarray, pa.StringArray, np.ndarray, np.ndarray]:
        """Where pieces begin, the distinct ones, each piece's number among them, and each text's
        first piece with the total last."""
        at = np.flatnonzero(mask)
        offsets = np.append(self.byte[at], len(self.raw)).astype(np.int32)
        found = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(self.raw)).dictionary_encode()
        return at, found.dictionary, found.indices.to_numpy(), np.searchsorted(at, self.starts)


def gathered(values: list[bytes], index: np.ndarray, bounds: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of all texts, and each text's number of ids. `values` has the ids of each
    distinct piece as 32-bit integers, `index` the texts' pieces, `bounds` each text's first;
    `end` closes each text."""
    counts = np.fromiter(map(len, values), np.int64, len(values)) // 4
    flat = np.frombuffer(b"".join(values), np.uint32)
    first = np.cumsum(counts) - counts
    n = counts[index]
    done = np.concatenate(([0], np.cumsum(n)))
    ids = flat[np.repeat(first[index] - done[:-1], n) + np.arange(done[-1])]
    per = np.diff(done[bounds])
    if end is None:
        return ids, per
    out = np.full(len(ids) + len(per), end, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(per)), per)] = ids
    return out, per + 1


class Table:
    """Values of pieces, made once for many. A full table is set aside for a new one, to which
    entries move when they are used again: it holds twice `entries` at most, or one batch."""

    def __init__(self, make: Callable[[list[str], np.ndarray], list[bytes]], entries: int, together: int = 100_000):
        self.make, self.entries, self.together = make, entries, together
        self.table: dict[str, bytes] = {}
        self.aside: dict[str, bytes] = {}

    def of(self, pieces: list[str], kind: np.ndarray) -> list[bytes]:
        """Values of distinct pieces; new ones are made, `kind` goes along to `make`."""
        if len(self.table) > self.entries:
            self.table, self.aside = {}, self.table
        found = list(map(self.table.get, pieces))
        if self.aside:
            for i, value in enumerate(found):
                if value is None and (value := self.aside.get(pieces[i])) is not None:
                    found[i] = self.table[pieces[i]] = value
        new = [i for i, value in enumerate(found) if value is None]
        for k in range(0, len(new), self.together):
            some = new[k : k + self.together]
            for i, value in zip(some, self.make([pieces[i] for i in some], kind[some]), strict=True):
                found[i] = self.table[pieces[i]] = value
        return found


def groups(texts: pa.StringArray, most: int = TOGETHER) -> Iterator[pa.StringArray]:
    """Slices of about `most` bytes, one text at least."""
    ends, at = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)), 0
    while at < len(texts):
        cut = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield texts.slice(at, cut - at)
        at = cut


def encoded(texts: list[str | None] | pa.Array, one: Callable[[pa.StringArray, int | None], tuple[np.ndarray, np.ndarray]], end: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids and numbers of ids of all texts, by `one`, which takes some texts and an end id."""
    ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for some in groups(as_strings(texts)):
        if len(some) == 1 and len(text := some[0].as_py()) > 2 * TOGETHER and len(parts := parts_of(text)) > 1:
            found = [one(pa.array([p], pa.string()), end if k == len(parts) - 1 else None) for k, p in enumerate(parts)]
            found = (np.concatenate([f[0] for f in found]), np.array([sum(int(f[1][0]) for f in found)]))
        else:
            found = one(some, end)
        ids.append(found[0])
        counts.append(found[1])
    return np.concatenate(ids), np.concatenate(counts)
