"""One CSV file read by many tasks, quoted line feeds included, with the number of each record.

Lines are dealt by Spark's text source, so a task can't know whether its first line begins inside
a quoted cell. A first pass sums up what each range of the file does to either state; a scan over
these sums, a row a range, gives each range its true state and the number of its first record. In
a second pass every task makes records of its lines. Only records that cross a range are put
together by their number, all others stay where they are.

It works on bytes: in UTF-8, GB18030, Big5, Shift-JIS and EUC-KR no byte of a longer character is a
quote, a comma or a line feed. UTF-16 is left to Spark's own reader.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import Scratch

#: A cell: quoted, with doubled quotes inside and whatever follows the closing one, or plain.
_CELL = r'(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+)?+'
#: Lines that end outside quotes if they begin outside of them, and if they begin inside.
FROM_OUTSIDE = rf"^{_CELL}(?:,{_CELL})*+\z"
FROM_INSIDE = rf'^(?:[^"]++|"")*+"[^,]*+(?:,{_CELL})*+\z'
OPTIONS = {"multiLine": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "nullValue": ""}


@dataclass(frozen=True)
class Range:
    """What a range of the file does: the state it ends in, and how many records begin in it, if it
    begins outside quotes (index 0) and if it begins inside (index 1)."""

    begin: int
    inside_after: tuple[bool, bool]
    records: tuple[int, int]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (begin, line, out, within): the range that a line is in, its bytes, and whether it ends
    outside quotes if it begins outside and inside; a range's lines are in order within a task."""
    text = spark.read.option("lineSep", "\n").text(str(path))
    value = F.col("value")
    quoted = F.contains(value, F.lit('"'))
    out = F.when(quoted, value.rlike(FROM_OUTSIDE)).otherwise(True)
    within = F.when(quoted, value.rlike(FROM_INSIDE)).otherwise(False)
    return text.select(F.col("_metadata.file_block_start").alias("begin"), value.cast("binary").alias("line"), out.alias("out"), within.alias("within"))


def states(out: np.ndarray, within: np.ndarray, inside: bool) -> tuple[np.ndarray, bool]:
    """Whether each line begins inside quotes, and whether the last one ends there, if the first
    begins `inside`. A line sets the state, keeps it or turns it."""
    if not len(out):
        return np.zeros(0, bool), inside
    turns = np.cumsum(~out & within)
    sets = np.maximum.accumulate(np.where(out == within, np.arange(len(out)), -1))
    since = turns - np.where(sets >= 0, turns[sets], 0)
    after = np.where(sets >= 0, ~out[sets], inside) ^ (since % 2 == 1)
    return np.concatenate(([inside], after[:-1])), bool(after[-1])


def _blank(line: pa.Array) -> np.ndarray:
    return pc.is_in(line, pa.array([b"", b"\r"], pa.binary())).to_numpy(zero_copy_only=False)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of lines of one range, in order."""
    for b in batches:
        begin = b.column(0).to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(begin)) + 1, [len(begin)]))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if j > i:
                yield int(begin[i]), b.slice(i, j - i)


def _flags(b: pa.RecordBatch) -> list[np.ndarray]:
    return [b.column(k).to_numpy(zero_copy_only=False).astype(bool) for k in (2, 3)]


def summarize(found: DataFrame) -> list[Range]:
    """The ranges of the file in order, a row for each on the driver. Ranges without a line are
    left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, inside, records = None, [False, True], [0, 0]

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"begin": at, "i0": inside[0], "i1": inside[1], "n0": records[0], "n1": records[1]}])

        for begin, b in _parts(batches):
            if begin != at:
                if at is not None:
                    yield told()
                at, inside, records = begin, [False, True], [0, 0]
            blank = _blank(b.column(1))
            for k in (0, 1):
                before, inside[k] = states(*_flags(b), inside[k])
                records[k] += int((~before & ~blank).sum())
        if at is not None:
            yield told()

    rows = found.mapInArrow(run, "begin long, i0 boolean, i1 boolean, n0 long, n1 long").collect()
    return [Range(r["begin"], (r["i0"], r["i1"]), (r["n0"], r["n1"])) for r in sorted(rows, key=lambda r: r["begin"])]


def placed(ranges: list[Range]) -> tuple[dict[int, tuple[bool, int]], int]:
    """For each range whether it begins inside quotes and the number of the first record that begins
    in it, and the number of records of the file."""
    out, inside, done = {}, False, 0
    for r in ranges:
        out[r.begin] = inside, done
        done += r.records[inside]
        inside = r.inside_after[inside]
    return out, done


def pieces(found: DataFrame, at: dict[int, tuple[bool, int]]) -> DataFrame:
    """Rows (record, begin, whole, raw): records by their number, from 0; a record that crosses
    ranges is in pieces, one a range, none of them whole."""

    kinds = {"record": pa.int64(), "begin": pa.int64(), "whole": pa.bool_(), "raw": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The record that lines are held of, and whether it begins in this range.
        here, inside, number, mine, held, rows = None, False, 0, False, [], []

        def close(whole: bool) -> None:
            if held:
                rows.append((number - 1, here, whole, b"\n".join(held)))
                held.clear()

        def told() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))

        for begin, b in _parts(batches):
            if begin != here:
                close(mine and not inside)
                here, (inside, number), mine = begin, at[begin], False
            before, after = states(*_flags(b), inside)
            first, blank = (~before).tolist(), _blank(b.column(1)).tolist()
            for line, outside, empty in zip(b.column(1).to_pylist(), first, blank, strict=True):
                if outside:
                    close(mine)
                    if empty:
                        continue
                    number, mine = number + 1, True
                held.append(line)
            inside = after
            yield told()
        close(mine and not inside)
        yield told()

    return found.mapInArrow(run, "record long, begin long, whole boolean, raw binary")


def _texts(found: DataFrame, charset: str) -> DataFrame:
    """Rows (record, text) of whole records; bytes that aren't of the encoding are an error."""
    text = F.decode("raw", charset)
    own = found.where("whole").select("record", text.alias("text"))
    parts = found.where("not whole").groupBy("record").agg(F.array_sort(F.collect_list(F.struct("begin", text.alias("text")))).alias("parts"))
    crossing = parts.select("record", F.array_join("parts.text", "\n").alias("text"))
    both = own.unionByName(crossing)
    return both.select("record", F.when(F.endswith("text", F.lit("\r")), F.expr("substring(text, 1, length(text) - 1)")).otherwise(F.col("text")).alias("text"))


def unique_names(header: list[str]) -> list[str]:
    """Headers as column names: an empty one by its place, repeated ones with a number."""
    out, seen = [], {}
    for k, given in enumerate(header):
        name = given or f"Unnamed: {k}"
        n = seen.get(name, 0)
        seen[name] = n + 1
        out.append(f"{name}.{n}" if n else name)
    return out


@dataclass
class Scan:
    """A file's data rows as text columns after `__row`, which counts from 2, and how many there are.
    The rows are read from a scratch table that `scratch` owns."""

    frame: DataFrame
    total: int
    ranges: int
    scratch: Scratch


def cells(text: Column, width: int) -> Column:
    schema = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(width)])
    return F.from_csv(text, schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), OPTIONS)


def scan(spark: SparkSession, path: str, charset: str, *, most: int | None = None, check=None, owner: Scratch | None = None) -> Scan:
    """Reads `path`. `check(n_rows, most)` may refuse a file by the number of its rows, before its
    records are made. A file without a record has no columns."""
    found = lines(spark, path)
    at, total = placed(summarize(found))
    if most is not None and check is not None:
        check([max(0, total - 1)], most)
    scratch = owner or Scratch(spark)
    texts = _texts(scratch.staged(pieces(found, at), "pieces"), charset)
    first = texts.where("record = 0").collect()
    if not first:
        return Scan(spark.createDataFrame([], "__row int"), 0, len(at), scratch)
    head = next(csv.reader(io.StringIO(first[0]["text"].removeprefix("\ufeff"), newline="")))
    names = unique_names(head)
    rows = texts.where("record > 0").select((F.col("record") + 1).cast("int").alias("__row"), cells(F.col("text"), len(names)).alias("c"))
    frame = rows.select("__row", *(F.col(f"c.c{k}").alias(n) for k, n in enumerate(names)))
    return Scan(frame, total - 1, len(at), scratch)
