"""Ids of the tokenizers library for whole texts, repeated pieces encoded once."""

from __future__ import annotations

import functools
import json
import os
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import pieces

#: Entries of a worker's table, of which there are two; about 200 bytes each.
TABLE_ENTRIES = 300_000
#: Classes of characters: white space as Unicode defines it, letters, numbers, others that all
#: versions of Unicode agree on, and what is not cut from its neighbours.
BLANK, LETTER, NUMBER, OTHER, MIXED = range(5)
BLANKS = "\t-\r \x85\xa0  -     　"


@functools.cache
def _classes() -> np.ndarray:
    out, old = np.full(0x110000, MIXED, np.uint8), unicodedata.ucd_3_2_0
    for c in range(0x110000):
        kinds = {x.category(chr(c))[0] for x in (unicodedata, old)}
        if len(kinds) == 1 and (kind := kinds.pop()) != "C":
            out[c] = {"L": LETTER, "N": NUMBER}.get(kind, OTHER)
    out[0x20:0x7F][out[0x20:0x7F] == MIXED] = OTHER
    out[ord("'")] = MIXED  # begins contractions
    blanks = BLANKS.replace("-", "")
    for c in [*blanks, *map(chr, range(9, 14)), *map(chr, range(0x2000, 0x200B))]:
        out[ord(c)] = BLANK
    return out


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte: printable ones stand for
    themselves, the others for the letters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class SegmentEncoder:
    """Encodes texts with a tokenizers file.

    A byte-level pre-tokenizer cuts texts at changes between white space, letters, numbers and
    other characters; the library's model encodes each such piece apart. Runs with characters
    that the versions of Unicode class differently, or with an apostrophe, stay whole and are
    cut by the library itself. Files with another pre-tokenizer get whole texts, and so do texts
    with the spelling of an added token, unless `plain` takes special ones for ordinary text.
    """

    def __init__(self, path: str, entries: int = TABLE_ENTRIES, *, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        pre, model = kind.get("pre_tokenizer") or {}, kind.get("model") or {}
        self.apart = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not kind.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout")
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values() if not (plain and t.special)]
        self.plain, self.model, self.letters = plain, self.library.model, _byte_letters()
        self.size = self.library.get_vocab_size()
        self.table = pieces.Table(self._make, entries)

    def yields(self, id_: int) -> bool:
        """Whether a text can have this id."""
        special = self.library.get_added_tokens_decoder().get(id_)
        return self.library.id_to_token(id_) is not None and not (self.plain and special and special.special)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _make(self, some: list[str], mixed: np.ndarray) -> list[bytes]:
        """Ids of new pieces: by the model alone, of mixed ones by the whole library."""
        letters, model = self.letters, self.model.tokenize
        out = [b"" if m else array("I", [t.id for t in model(s.encode().decode("latin-1").translate(letters))]).tobytes() for s, m in zip(some, mixed.tolist(), strict=True)]
        rest = np.flatnonzero(mixed).tolist()
        for i, ids in zip(rest, self._whole([some[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def _some(self, texts: pa.StringArray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        c = pieces.Cut(texts)
        kind = _classes()[c.chars]
        blank, space = kind == BLANK, c.chars == 32
        before = lambda x: np.concatenate((np.zeros(1, x.dtype), x[:-1]))[: len(x)]
        last = np.concatenate((c.begins[1:], np.ones(1, bool)))[: len(blank)]  # of its text
        run = c.begins | (blank != before(blank))
        # The last blank before other characters is a piece, or a space the start of the next.
        mask = c.begins | (blank & run) | (blank & ~last & ~np.append(blank[1:], True)[: len(blank)])
        mask |= ~blank & run & (c.begins | ~before(space))
        # Runs of other characters are cut where the class changes, if no class is mixed.
        change, whole = ~blank & ~run & (kind != before(kind)), None
        if (rare := kind == MIXED).any():
            number = np.cumsum(run)
            whole = np.zeros(number[-1] + 1, bool)
            whole[number[rare]] = True
            whole = whole[number]
            change &= ~whole
        at, distinct, index, bounds = c.pieces(mask | change)
        mixed = np.zeros(len(distinct), bool)
        if whole is not None:
            ends = np.append(at[1:], len(kind)) - 1
            mixed[index[whole[ends] & ~blank[ends]]] = True
        return pieces.gathered(self.table.of(distinct.to_pylist(), mixed), index, bounds, end)

    def _rare(self, texts: pa.StringArray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """As `_some`, with texts that the library has to see whole."""
        whole = np.full(len(texts), not self.apart)
        for word in self.added if self.apart else ():
            whole |= pc.match_substring(texts, word).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._some(texts, end)
        ids, counts = self._some(texts.filter(pa.array(~whole)), end) if not whole.all() else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        closing = b"" if end is None else np.uint32(end).tobytes()
        own = iter([x + closing for x in self._whole(texts.filter(pa.array(whole)).to_pylist())])
        cut, raw = np.concatenate(([0], np.cumsum(counts))).tolist(), ids.tobytes()
        rest = iter([raw[4 * a : 4 * b] for a, b in zip(cut, cut[1:], strict=False)])
        out = [next(own if w else rest) for w in whole.tolist()]
        return np.frombuffer(b"".join(out), np.uint32), np.array([len(x) // 4 for x in out], np.int64)

    def encode(self, texts: list[str | None] | pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, each closed by the end id if there is one, and their numbers."""
        return pieces.encoded(texts, self._rare, end)

    def payloads(self, texts: list[str | None], end: int | None) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, then the end id."""
        ids, counts = self.encode(texts, end)
        raw, cut = ids.astype("<u4").tobytes(), np.concatenate(([0], np.cumsum(counts))).tolist()
        return [raw[4 * a : 4 * b] for a, b in zip(cut, cut[1:], strict=False)]


@functools.lru_cache(2)
def worker_encoder(path: str, plain: bool = False) -> SegmentEncoder:
    """One encoder for all tasks of a Python worker."""
    return SegmentEncoder(path, plain=plain)
