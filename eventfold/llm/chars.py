"""Whole texts as arrays of code points, lower-cased, everything between words one space."""

from __future__ import annotations

import functools

import numpy as np

SPACE = 32


@functools.cache
def _tables(digits: bool) -> np.ndarray:
    """For each code point its lower-case form, or a space if it is no part of a word."""
    out = np.full(0x110000, SPACE, np.uint32)
    for c in [*range(0xD800), *range(0xE000, 0x110000)]:
        ch = chr(c)
        if ch.isalpha() or (digits and ch.isdigit()):
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def words_of(texts: list[str | None], digits: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each as ' word word ' (a text without words: one space), and
    the start of each text, with the total last."""
    table = _tables(digits)
    raw = np.frombuffer("".join(f" {t or ''} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t or "") + 2 for t in texts), np.int64, len(texts))
    chars = table[raw]
    first = np.zeros(len(chars), bool)
    first[np.cumsum(lengths) - lengths] = True
    blank = chars == SPACE
    # A space stays if a text starts there or the character before it is none.
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep |= first
    kept = np.concatenate(([0], np.cumsum(keep)))
    return chars[keep], kept[np.concatenate(([0], np.cumsum(lengths)))]


def grams(chars: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """Hash bucket of the n-gram that starts at each position; the last n - 1 are unset."""
    h = np.full(len(chars), 2166136261 + n, np.uint32)
    size = max(0, len(chars) - n + 1)
    with np.errstate(over="ignore"):
        for k in range(n):
            h[:size] = (h[:size] ^ chars[k : k + size]) * np.uint32(16777619)
            h[:size] ^= h[:size] >> np.uint32(15)
    return h & np.uint32(buckets - 1)


def text_groups(sizes: np.ndarray, most: int = 1_000_000):
    """Slices of a list of texts with about `most` characters each, one text at least."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        cut = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, cut)
        at = cut
