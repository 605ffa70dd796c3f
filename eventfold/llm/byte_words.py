"""Words of many texts as byte strings and indices into the distinct ones, found in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Kinds of byte: part of a word, a gap between words, an end that no phrase crosses.
WORD, GAP, END = 0, 1, 2


def kinds(gaps: bytes, ends: bytes) -> np.ndarray:
    """The kind of each of the 256 bytes; bytes from 128 on are parts of words."""
    out = np.zeros(256, np.uint8)
    out[list(gaps)] = GAP
    out[list(ends)] = END
    return out


#: a-z, 0-9 and everything beyond ASCII make words.
LETTERS = kinds(bytes(b for b in range(128) if not (chr(b).isalnum())), b"")
#: Everything but space and tab makes words; sentence marks and line ends part phrases.
PHRASES = kinds(b" \t", b".,;:!?\n\x0b\x0c\r")

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def cut(texts: list[str | None], table: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of the texts in order, A-Z in lower case: words as dictionary-encoded bytes, the
    text that each stands in, whether a piece (what no END parts) begins with it, and the number of
    words of each text. A null text has none."""
    whole = [(t or "").encode("utf-8", "surrogatepass") + b"\0" for t in texts]
    data = _LOWER[np.frombuffer(b"".join(whole), np.uint8)]
    lengths = np.fromiter(map(len, whole), np.int64, len(whole))
    closes = np.cumsum(lengths) - 1  # where a text's own end stands
    kind = table[data]
    kind[closes] = END
    inside = kind == WORD
    flips = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    starts, ends = flips[0::2], flips[1::2]
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    letters = data[inside]
    if offsets[-1] < 2**31:
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(letters)])
    else:
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    text = np.searchsorted(closes, starts, "right")
    parted = np.searchsorted(np.flatnonzero(kind == END), starts)
    first = np.ones(len(starts), bool)
    first[1:] = parted[1:] != parted[:-1]
    return words.dictionary_encode(), text, first, np.bincount(text, minlength=len(texts))
