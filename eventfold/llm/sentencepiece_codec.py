"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A segment of text is encoded with an agenda of adjacent symbol pairs: the pair whose
merged piece has the best score is merged first, the leftmost of equal ones, until no
pair forms a piece. Characters that end up outside the vocabulary become byte pieces.
Short segments are merged many at a time in numpy, one agenda pop per segment and
round; long ones use a heap.

Two adjacent characters that stand together in no piece of the vocabulary never come into
one symbol, so a text falls into segments between them that don't merge with each other.
Segments repeat; each task keeps a bounded table of them. Every segment that enters the
table is compared with the sentencepiece library in the same Arrow batch; should they ever
differ, the job ends with an error that names the segment.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import pieces

SPACE = "▁"
#: Entries of a task's table, of which there are two; about 200 bytes each. They end with the
#: task: a Python worker goes on to other stages, which need the memory.
TABLE_ENTRIES = 150_000
#: Segments of up to so many characters are merged in numpy.
WIDE = 40
NEVER = np.int32(2**31 - 1)
#: Characters below this have their pairs in a table, other pairs in a sorted list.
NEAR = 0x250


class BpeVocabulary:
    """Merge rules of a model file, as sorted arrays of symbol pairs."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = sp.get_piece_size()
        self.eos = sp.eos_id()
        pieces = {}
        self.byte_ids = np.full(256, -1, np.int32)
        spelled: list[bytes] = [b""] * size
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                spelled[i] = bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                pieces[piece] = i
                spelled[i] = piece.replace(SPACE, " ").encode()
        if (self.byte_ids < 0).any() or sp.normalize("a  Å ") != f"{SPACE}a{SPACE}{SPACE}Å{SPACE}":
            raise ValueError("only vocabularies with byte pieces, a space prefix and no rewriting of text are handled")
        # Whether characters merge with the one before, by a number for each that occurs in a
        # longer piece; numbers below NEAR are characters themselves.
        pairs = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}
        rare = sorted({c for p in pairs for c in p if ord(c) >= NEAR})
        number = {c: NEAR + 1 + k for k, c in enumerate(rare)}
        self.number = np.full(0x110000, NEAR, np.uint32)
        self.number[:NEAR] = np.arange(NEAR)
        for c, n in number.items():
            self.number[ord(c)] = n
        self.number[0x20] = self.number[ord(SPACE)]  # a space is its mark
        self.width = NEAR + 1 + len(rare)
        self.glue = np.zeros((NEAR, NEAR), bool)
        far = set()
        for a, b in pairs:
            a, b = number.get(a, ord(a)), number.get(b, ord(b))
            if a < NEAR and b < NEAR:
                self.glue[a, b] = True
            else:
                far.add(a * self.width + b)
        self.far = np.array([*sorted(far), 2**62], np.int64)
        if any("\n" in p for p in pairs):
            raise ValueError("only vocabularies in which line feeds stand alone are handled")
        self.symbols = dict(pieces)
        for piece in pieces:  # characters that occur in pieces but are none can still merge
            for ch in piece:
                self.symbols.setdefault(ch, size + len(self.symbols))
        self.unknown = size + len(self.symbols) + 1
        self.stride = np.int64(self.unknown + 1)
        levels = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in pieces.values()}, reverse=True))}
        rules = {}
        for piece, i in pieces.items():
            for k in range(1, len(piece)):
                a, b = self.symbols.get(piece[:k]), self.symbols.get(piece[k:])
                if a is not None and b is not None:
                    rules[a * int(self.stride) + b] = (levels[sp.get_score(i)], i)
        self.rules = rules
        self.keys = np.array(sorted(rules) + [2**62], np.int64)
        self.rank = np.array([rules[k][0] for k in self.keys[:-1].tolist()] + [NEVER], np.int32)
        self.merged = np.array([rules[k][1] for k in self.keys[:-1].tolist()] + [0], np.int32)
        self.lengths = np.array([len(x) for x in spelled], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.size = size

    def _at(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair's rule, that of NEVER where there is none."""
        key = left.astype(np.int64) * self.stride + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, at, len(self.keys) - 1)

    def _spell(self, symbol: int, text: str) -> list[int]:
        return [symbol] if symbol < self.size else [int(self.byte_ids[b]) for b in text.encode()]

    def merge_long(self, segment: str) -> list[int]:
        """Heap agenda over one segment, with links between the symbols left."""
        ids = [self.symbols.get(c, self.unknown) for c in segment]
        text = list(segment)
        n, rules, stride = len(ids), self.rules, int(self.stride)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (rule := rules.get(ids[i] * stride + ids[j])):
                heapq.heappush(agenda, (rule[0], i, j, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, a, b = heapq.heappop(agenda)
            if ids[i] != a or ids[j] != b or after[i] != j:
                continue  # one of the two has been merged since
            ids[i], text[i], ids[j] = rules[a * stride + b][1], text[i] + text[j], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [x for i in range(n) if ids[i] >= 0 for x in self._spell(ids[i], text[i])]

    def merge_many(self, segments: list[str]) -> list[list[int]]:
        """One agenda per row, all rows popped together."""
        width = max(map(len, segments))
        flat = [self.symbols.get(c, self.unknown) for s in segments for c in s]
        counts = np.fromiter(map(len, segments), np.int64, len(segments))
        mask = np.arange(width) < counts[:, None]
        symbol = np.full(mask.shape, -1, np.int32)
        symbol[mask] = flat
        length = np.zeros(mask.shape, np.int16)  # characters in each symbol
        length[mask] = 1
        rank = np.full((len(segments), max(1, width - 1)), NEVER, np.int32)
        if width > 1:
            both = mask[:, 1:]
            rank[both] = self.rank[self._at(symbol[:, :-1][both], symbol[:, 1:][both])]
        live = np.flatnonzero(rank.min(axis=1) < NEVER)
        column = np.arange(width)
        while len(live):
            s, n, r = symbol[live], length[live], rank[live]
            rows = np.arange(len(live))
            j = r.argmin(axis=1)
            s[rows, j] = self.merged[self._at(s[rows, j], s[rows, j + 1])]
            n[rows, j] += n[rows, j + 1]
            shift = np.minimum(column + (column > j[:, None]), width - 1)
            s, n = np.take_along_axis(s, shift, 1), np.take_along_axis(n, shift, 1)
            s[:, -1], n[:, -1] = -1, 0
            if width > 2:
                r = np.take_along_axis(r, np.minimum(shift[:, : width - 1], width - 2), 1)
            r[:, -1] = NEVER
            for k in (j - 1, j):  # the pairs on either side of the merged symbol
                ok = np.flatnonzero((k >= 0) & (k < width - 1))
                ok = ok[s[ok, k[ok] + 1] >= 0]
                r[ok, k[ok]] = self.rank[self._at(s[ok, k[ok]], s[ok, k[ok] + 1])]
                gone = np.flatnonzero((k >= 0) & (k < width - 1))
                gone = gone[s[gone, k[gone] + 1] < 0]
                r[gone, k[gone]] = NEVER
            symbol[live], length[live], rank[live] = s, n, r
            live = live[r.min(axis=1) < NEVER]
        out = []
        kept = symbol >= 0
        plain = ~((symbol >= self.size) & kept).any(axis=1)
        ends = kept.sum(axis=1).tolist()
        whole = symbol.tolist()
        for row, segment in enumerate(segments):
            ids = whole[row][: ends[row]]
            if not plain[row]:
                at, spelled = 0, []
                for x, n in zip(ids, length[row].tolist(), strict=False):
                    spelled += self._spell(x, segment[at : at + n])
                    at += n
                ids = spelled
            out.append(ids)
        return out

    def merges(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether adjacent characters stand together in some piece."""
        a, b = self.number[left], self.number[right]
        out = np.zeros(len(a), bool)
        near = (a < NEAR) & (b < NEAR)
        out[near] = self.glue[a[near], b[near]]
        rest = np.flatnonzero(~near & (a != NEAR) & (b != NEAR))
        key = a[rest].astype(np.int64) * self.width + b[rest]
        out[rest] = self.far[np.searchsorted(self.far, key)] == key
        return out

    def _by_library(self, segments: list[str]) -> list[list[int]]:
        # Between line feeds, which merge with nothing, a segment is encoded as inside a text;
        # many are encoded in one call and parted at the line feeds' ids.
        lines = [k for k, s in enumerate(segments) if s != "\n"]
        out = [[self.symbols["\n"]] if "\n" in self.symbols else [int(self.byte_ids[10])]] * len(segments)
        feed = out[0][0] if out else 0
        for k in range(0, len(lines), 1000):
            some = lines[k : k + 1000]
            ids = np.array(self.library.encode("\n" + "\n".join([segments[i] for i in some]) + "\n", num_threads=1), np.int64)
            cuts = np.flatnonzero(ids == feed).tolist()
            if len(cuts) != len(some) + 1:
                raise ValueError("the library joins line feeds with other text")
            for i, a, b in zip(some, cuts, cuts[1:], strict=False):
                out[i] = ids[a + 1 : b].tolist()
        return out

    def encode_segments(self, segments: list[str]) -> list[list[int]]:
        """Ids of distinct, non-empty segments from the agenda. They are checked against the
        library; a difference is an error."""
        own: dict[str, list[int]] = {}
        marked = {s: s.replace(" ", SPACE) for s in segments}
        short: list[str] = []
        for s in segments:
            if len(s) > WIDE:
                own[s] = self.merge_long(marked[s])
            else:
                short.append(s)
        short.sort(key=len)
        for k in range(0, len(short), 4096):
            part = short[k : k + 4096]
            own.update(zip(part, self.merge_many([marked[s] for s in part]), strict=True))
        for s, ids in zip(segments, self._by_library(segments), strict=True):
            if own[s] != ids:
                raise ValueError(f"agenda and library differ on segment {s!r}: {own[s]}, {ids}")
        return [own[s] for s in segments]


class Codec:
    """Encoder and decoder of one task, with its bounded table of segments."""

    def __init__(self, model_path: str, entries: int = TABLE_ENTRIES):
        self.vocabulary = v = BpeVocabulary(model_path)
        self.table = pieces.Table(lambda some, _: [array("i", ids).tobytes() for ids in v.encode_segments(some)], entries)

    def _some(self, texts: pa.StringArray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        c = pieces.Cut(texts)
        mask = c.begins.copy()
        mask[1:] |= ~self.vocabulary.merges(c.chars[:-1], c.chars[1:])
        _, distinct, index, bounds = c.pieces(mask)
        return pieces.gathered(self.table.of(distinct.to_pylist(), np.zeros(len(distinct), bool)), index, bounds, end)

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat int32 ids of all texts, each closed by the end id, and each text's number of ids."""
        given = pieces.as_strings(texts)
        # The library puts a space before a text that is not empty.
        lead = pc.if_else(pc.equal(pc.binary_length(given), 0), "", " ")
        ids, counts = pieces.encoded(pc.binary_join_element_wise(lead, given, ""), self._some, self.vocabulary.eos)
        return ids.view(np.int32), counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of flat ids: pieces joined, space marks as spaces, without the first one."""
        v = self.vocabulary
        size, start = v.lengths[ids], v.starts[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        flat = v.spelled[np.repeat(start - (ends - size), size) + np.arange(total)].tobytes() if total else b""
        bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))].tolist()
        out = []
        for a, b in zip(bounds, bounds[1:], strict=False):
            text = flat[a:b].decode("utf-8", "replace")
            out.append(text[1:] if text[:1] == " " else text)
        return out


def encode_decode(docs: DataFrame, model_path: str, *, key: str = "doc_id", text: str = "text", decode: bool = True) -> DataFrame:
    """Rows (key, ids array<int>, decoded string) of every row of `docs`, in no order.

    Whole texts are encoded, the end id comes last. Null and empty texts give the end id
    alone and an empty decoded text. Rows are never merged: repeated rows and repeated or
    null keys give one row each. Other columns are not read. An empty table gives no rows.
    With `decode=False` the decoded column is null.
    """
    schema = T.StructType([docs.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False), T.StructField("decoded", T.StringType())])
    schema[0].name = "key"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for whole in batches:
            codec = codec or Codec(model_path)
            for batch in by_size(whole, 500_000):
                ids, counts = codec.encode(batch.column(1))
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                back = pa.array(codec.decode(ids, counts) if decode else [None] * batch.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), back], ["key", "ids", "decoded"])

    out = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("key", key)


def by_size(batch: pa.RecordBatch, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a (key, text) batch with about `most` bytes of text each, one row at least."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = size[at - 1] if at else 0
        cut = max(at + 1, int(np.searchsorted(size, done + most, "right")))
        yield batch.slice(at, cut - at)
        at = cut
