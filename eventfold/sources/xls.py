"""Binary workbooks (BIFF8 in an OLE compound file) with the standard library, read alone."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from .xlsx import _DATE_IDS, Workbook, is_date_format, number_text

MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
_FREE = 0xFFFFFFFA  # sector numbers from here on end a chain
# Record types of the format.
_EOF, _FILEPASS, _DATEMODE, _CONTINUE, _BOUNDSHEET, _MULRK, _XF, _SST, _LABELSST = 0x0A, 0x2F, 0x22, 0x3C, 0x85, 0xBD, 0xE0, 0xFC, 0xFD
_FORMULA, _NUMBER, _LABEL, _BOOLERR, _STRING, _RK, _FORMAT = 0x06, 0x203, 0x204, 0x205, 0x207, 0x27E, 0x41E
_ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}


def streams(data: bytes) -> dict[str, bytes]:
    """The named streams of an OLE compound file."""
    if data[:8] != MAGIC:
        raise ValueError("not an OLE compound file")
    shift, mini_shift = struct.unpack_from("<HH", data, 30)
    n_fat, first_dir, _, cutoff, first_mini, _, first_difat = struct.unpack_from("<II I I I I I", data, 44)
    size = 1 << shift
    sector = lambda k: data[(k + 1) * size : (k + 2) * size]
    numbers = lambda raw: list(struct.unpack(f"<{len(raw) // 4}I", raw))
    fats = numbers(data[76:512])
    while first_difat < _FREE:
        more = numbers(sector(first_difat))
        fats, first_difat = fats + more[:-1], more[-1]
    table = [x for k in fats[:n_fat] if k < _FREE for x in numbers(sector(k))]

    def chain(k: int, of: list[int], part) -> bytes:
        out, seen = [], set()
        while k < _FREE:
            if k in seen or k >= len(of):
                raise ValueError("a broken chain of sectors")
            seen.add(k)
            out.append(part(k))
            k = of[k]
        return b"".join(out)

    entries = chain(first_dir, table, sector)
    mini_table = numbers(chain(first_mini, table, sector)) if first_mini < _FREE else []
    out, small = {}, b""
    for at in range(0, len(entries), 128):
        length, kind = struct.unpack_from("<HB", entries, at + 64)
        start, total = struct.unpack_from("<II", entries, at + 116)
        name = entries[at : at + max(0, length - 2)].decode("utf-16-le")
        if kind == 5:
            small = chain(start, table, sector)
        elif kind == 2:
            mini = 1 << mini_shift
            raw = chain(start, table, sector) if total >= cutoff else chain(start, mini_table, lambda k: small[k * mini : (k + 1) * mini])
            out[name] = raw[:total]
    return out


def records(data: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """(type, parts) of the records up to the substream's end: its data, then those of the
    records that continue it."""
    depth, held = 0, None
    while at + 4 <= len(data):
        kind, size = struct.unpack_from("<HH", data, at)
        body = data[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == _CONTINUE and held:
            held[1].append(body)
            continue
        if held:
            yield held
        held = (kind, [body])
        depth += (kind == 0x809) - (kind == _EOF)
        if kind == _EOF and depth <= 0:
            break
    if held:
        yield held


class _Reader:
    """Bytes over several parts; text that runs on into a part takes up its width flag anew."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.part, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n and self.part < len(self.parts):
            piece = self.parts[self.part][self.at : self.at + n - len(out)]
            out, self.at = out + piece, self.at + len(piece)
            if len(out) < n:
                self.part, self.at = self.part + 1, 0
        return out

    def text(self, n: int, wide: int) -> str:
        out = []
        while n and self.part < len(self.parts):
            there = (len(self.parts[self.part]) - self.at) >> wide
            if there == 0:
                self.part, self.at = self.part + 1, 1
                if self.part < len(self.parts):
                    wide = self.parts[self.part][0] & 1
                continue
            some = min(n, there)
            out.append(self.take(some << wide).decode("utf-16-le" if wide else "latin-1"))
            n -= some
        return "".join(out)

    def string(self, length: str = "<H") -> str:
        """A string with its length, and its runs and phonetic data skipped."""
        n = struct.unpack(length, self.take(struct.calcsize(length)))[0]
        flags = self.take(1)[0]
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out = self.text(n, flags & 1)
        self.take(4 * runs + extra)
        return out


def _rk(value: int) -> float:
    number = float((value - (1 << 32) if value & 0x80000000 else value) >> 2) if value & 2 else struct.unpack("<d", struct.pack("<Q", (value & 0xFFFFFFFC) << 32))[0]
    return number / 100 if value & 1 else number


class BinaryWorkbook(Workbook):
    """Sheets of a binary workbook's bytes, with the interface of Workbook. Rows are those of
    cells, which the format keeps in order; cells of formulas have their last values."""

    def __init__(self, data: bytes):
        found = streams(data)
        if "Workbook" not in found:
            raise ValueError("no BIFF8 workbook in the file")
        self.data, self.sheets, self.strings, self.dates, self.epoch_1904 = found["Workbook"], {}, [], [], False
        formats: dict[int, str] = {}
        for kind, parts in records(self.data):
            if kind == _FILEPASS:
                raise ValueError("the workbook is encrypted")
            if kind == _BOUNDSHEET and parts[0][5] == 0:
                reader = _Reader([parts[0][6:]])
                self.sheets[reader.string("<B")] = struct.unpack_from("<I", parts[0])[0]
            elif kind == _SST:
                reader = _Reader(parts)
                n = struct.unpack("<II", reader.take(8))[1]
                self.strings = [reader.string() for _ in range(n)]
            elif kind == _FORMAT:
                formats[struct.unpack_from("<H", parts[0])[0]] = _Reader([parts[0][2:]]).string()
            elif kind == _XF:
                used = struct.unpack_from("<H", parts[0], 2)[0]
                self.dates.append(used in _DATE_IDS or is_date_format(formats.get(used, "")))
            elif kind == _DATEMODE:
                self.epoch_1904 = struct.unpack_from("<H", parts[0])[0] == 1

    def _number(self, value: float, style: int) -> str:
        return number_text(value, style < len(self.dates) and self.dates[style], self.epoch_1904)

    def _cells(self, start: int) -> Iterator[tuple[int, int, str | None]]:
        waiting = None
        for kind, parts in records(self.data, start):
            body = parts[0]
            if kind == _STRING and waiting:
                yield (*waiting, _Reader(parts).string())
                waiting = None
                continue
            if kind not in (_LABELSST, _NUMBER, _RK, _MULRK, _LABEL, _BOOLERR, _FORMULA):
                continue
            row, column, style = struct.unpack_from("<HHH", body)
            if kind == _LABELSST:
                yield row, column, self.strings[struct.unpack_from("<I", body, 6)[0]]
            elif kind == _NUMBER:
                yield row, column, self._number(struct.unpack_from("<d", body, 6)[0], style)
            elif kind == _RK:
                yield row, column, self._number(_rk(struct.unpack_from("<I", body, 6)[0]), style)
            elif kind == _MULRK:
                for k in range((len(body) - 6) // 6):
                    style, value = struct.unpack_from("<HI", body, 4 + 6 * k)
                    yield row, column + k, self._number(_rk(value), style)
            elif kind == _LABEL:
                yield row, column, _Reader([body[6:], *parts[1:]]).string()
            elif kind == _BOOLERR:
                yield row, column, _ERRORS.get(body[6]) if body[7] else ("True" if body[6] else "False")
            elif body[12:14] != b"\xff\xff":
                yield row, column, self._number(struct.unpack_from("<d", body, 6)[0], style)
            elif body[6] == 0:
                waiting = (row, column)
            elif body[6] in (1, 2):
                yield row, column, _ERRORS.get(body[8]) if body[6] == 2 else ("True" if body[8] else "False")

    def rows(self, sheet: str) -> Iterator[tuple[int, dict[int, str | None]]]:
        number, cells = None, {}
        for row, column, text in self._cells(self.sheets[sheet]):
            if row != number and cells:
                yield number + 1, cells
                cells = {}
            number = row
            cells[column] = text
        if cells:
            yield number + 1, cells
