"""Workbooks written by tasks: each makes compressed pieces of a sheet's XML, the driver joins them.

A piece is raw DEFLATE ended by a sync flush, so that pieces stand behind one another as one stream.
The check sum of a sheet follows from those of its pieces and their lengths. No row passes through
the driver; it sees a line of sizes for each piece, and streams their bytes into the file.
"""

from __future__ import annotations

import functools
import os
import struct
import tempfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import xlsx
from .store import Scratch

#: XML that is compressed as one piece, about, and data rows of a sheet.
PIECE, MOST_ROWS = 1 << 20, (1 << 20) - 1
_POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32; the highest bit is the constant term."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = (b >> 1) ^ (_POLYNOMIAL if b & 1 else 0)
    return out


@functools.cache
def _zeros(exponent: int) -> int:
    """x to the power of eight times two to the exponent."""
    return 1 << 23 if exponent == 0 else _times(_zeros(exponent - 1), _zeros(exponent - 1))


def joined_crc(first: int, second: int, length: int) -> int:
    """CRC-32 of two byte strings behind one another, from theirs and the second one's length."""
    for k in range(length.bit_length()):
        if length >> k & 1:
            first = _times(first, _zeros(k))
    return first ^ second


def deflated(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    return packer.compress(data) + packer.flush(zlib.Z_SYNC_FLUSH)


#: An empty last block, which ends a stream of pieces.
END = zlib.compressobj(6, zlib.DEFLATED, -15).flush()


@dataclass
class Member:
    """A file of the archive: its pieces' sizes so far, and where it begins."""

    name: str
    crc: int = 0
    size: int = 0
    packed: int = len(END)
    at: int = 0

    def add(self, crc: int, size: int, packed: int) -> None:
        self.crc, self.size, self.packed = joined_crc(self.crc, crc, size), self.size + size, self.packed + packed


class Archive:
    """A zip file whose members' sizes and check sums are known before their bytes are written."""

    def __init__(self, out: BinaryIO):
        self.out, self.at, self.members = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, member: Member, pieces: Iterable[bytes]) -> None:
        member.at, name = self.at, member.name.encode()
        more = struct.pack("<HHQQ", 1, 16, member.size, member.packed)
        self._put(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x800, 8, 0, 33, member.crc, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(more)) + name + more)
        begin = self.at
        for piece in pieces:
            self._put(piece)
        self._put(END)
        if self.at - begin != member.packed:
            raise ValueError(f"{member.name} has {self.at - begin} bytes, not {member.packed}")
        self.members.append(member)

    def add_text(self, name: str, text: str) -> None:
        data = text.encode()
        packed, member = deflated(data), Member(name)
        member.add(zlib.crc32(data), len(data), len(packed))
        self.add(member, [packed])

    def close(self) -> None:
        begin = self.at
        for m in self.members:
            name, more = m.name.encode(), struct.pack("<HHQQQ", 1, 24, m.size, m.packed, m.at)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x800, 8, 0, 33, m.crc, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(more), 0, 0, 0, 0, 0xFFFFFFFF) + name + more)
        size, end, n = self.at - begin, self.at, len(self.members)
        self._put(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, size, begin))
        self._put(struct.pack("<IIQI", 0x07064B50, 0, end, 1))
        self._put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, n, n, 0xFFFFFFFF, 0xFFFFFFFF, 0))


def numbered(rows: DataFrame, order: list[Column], scratch: Scratch) -> tuple[DataFrame, int]:
    """Rows with `__line`, from 2 in the given order, and the last line."""
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = scratch.staged(sorted_.withColumn("__at", F.monotonically_increasing_id()), "sheet")
    part = F.shiftright("__at", 33)
    firsts, done = [], 1
    for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        firsts.append((r["part"], done))
        done += r["n"]
    before = F.broadcast(rows.sparkSession.createDataFrame(firsts, "__part long, __before long"))  # a row a range
    line = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(before, part == F.col("__part")).withColumn("__line", line).drop("__at", "__part", "__before"), done


def pieces(rows: DataFrame, band: str, columns: list[str]) -> DataFrame:
    """Rows (part, line, crc, size, packed): pieces of the XML of a sheet and of those that it goes on
    in, by their first line."""
    schema, most = "part long, line long, crc long, size long, packed binary", MOST_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, begin, last = [], 0, 0, -1

        def told() -> pa.RecordBatch:
            data = b"".join(held)
            return pa.RecordBatch.from_pylist([{"part": (begin - 2) // most, "line": begin, "crc": zlib.crc32(data), "size": len(data), "packed": deflated(data)}])

        for b in batches:
            for line, tone, *values in zip(*(c.to_pylist() for c in b.columns), strict=True):
                row = (line - 2) % most + 2
                if held and (line != last + 1 or row == 2 or size > PIECE):
                    yield told()
                    held, size = [], 0
                if not held:
                    begin = line
                last = line
                held.append(xlsx.row_xml(row, tone, values))
                size += len(held[-1])
        if held:
            yield told()

    named = [F.col(f"`{c}`").cast("string").alias(f"c{k}") for k, c in enumerate(columns)]
    return rows.select("__line", F.col(band).cast("int").alias("band"), *named).mapInArrow(run, schema)


def write(path: str, sheets: dict[str, tuple[list[str], DataFrame]], order: list[str], band: str, *, spread: bool = False) -> str:
    """Writes a workbook of frames: for each sheet its headers, which are columns of the frame. Rows
    are ordered by `order`; `band` numbers their colours. `path` is local, or in any store of Spark's.
    More rows than a sheet can hold are an error, unless they may `spread`: then it goes on in further
    sheets (`xlsx.continued`)."""
    spark = next(iter(sheets.values()))[1].sparkSession
    with Scratch(spark) as scratch, tempfile.TemporaryDirectory() as folder:
        local = os.path.join(folder, "book.xlsx") if ":" in path.split("/", 1)[0] else path
        found = []
        for name, (headers, rows) in sheets.items():
            placed, last = numbered(rows.select(*order, band, *(F.col(f"`{h}`") for h in headers if h not in (*order, band))), [F.col(c) for c in order], scratch)
            parts = max(1, -(-(last - 1) // MOST_ROWS))
            if parts > 1 and not spread:
                raise ValueError(f"{last - 1} rows are more than a sheet can hold")
            made = scratch.staged(pieces(placed, band, headers), "pieces")
            found += [(xlsx.continued(name, k), headers, made.where(F.col("part") == k), min(MOST_ROWS, last - 1 - k * MOST_ROWS) + 1) for k in range(parts)]
        with open(local, "wb") as out:
            book = Archive(out)
            for name, text in xlsx.frame_parts([name for name, *_ in found]).items():
                book.add_text(name, text)
            for i, (_, headers, made, last) in enumerate(found, 1):
                head, tail = (x.encode() for x in xlsx.sheet_ends(headers, last))
                member = Member(f"xl/worksheets/sheet{i}.xml")
                member.add(zlib.crc32(head), len(head), len(deflated(head)))
                for r in made.select("line", "crc", "size", F.octet_length("packed").alias("packed")).orderBy("line").collect():
                    member.add(r["crc"], r["size"], r["packed"])
                member.add(zlib.crc32(tail), len(tail), len(deflated(tail)))

                def body(made=made, head=head, tail=tail) -> Iterator[bytes]:
                    yield deflated(head)
                    for r in made.orderBy("line").select("packed").toLocalIterator():
                        yield bytes(r["packed"])
                    yield deflated(tail)

                book.add(member, body())
            book.close()
        if local != path:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            store.mkdirs(target.getParent())
            store.copyFromLocalFile(False, True, jvm.org.apache.hadoop.fs.Path(f"file://{local}"), target)
    return path
