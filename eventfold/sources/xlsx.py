"""XLSX workbooks with the standard library: a Python data source to read, a writer to export."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta
from typing import BinaryIO
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_DATE_IDS = {*range(14, 23), *range(45, 48)}


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _name(column: int) -> str:
    out = ""
    column += 1
    while column:
        column, r = divmod(column - 1, 26)
        out = chr(65 + r) + out
    return out


def is_date_format(code: str) -> bool:
    return bool(re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", code), re.I))


def number_text(number: float, dated: bool, epoch_1904: bool) -> str:
    """A cell's number as text, or as the day and time that it counts."""
    if dated:
        day = datetime(1904, 1, 1) if epoch_1904 else datetime(1899, 12, 30)
        return str((day + timedelta(seconds=round(number * 86400))).replace(microsecond=0))
    return str(int(number)) if number.is_integer() else repr(number)


def opened(data: bytes | BinaryIO) -> Workbook:
    """A workbook of either format, told apart by its first bytes; of a file no more is read than
    the sheets that are asked for, if it is a zip file."""
    from . import xls

    if isinstance(data, bytes):
        return xls.BinaryWorkbook(data) if data[:8] == xls.MAGIC else Workbook(data)
    first = data.read(8)
    data.seek(0)
    return xls.BinaryWorkbook(data.read()) if first == xls.MAGIC else Workbook(data)


def continued(name: str, k: int) -> str:
    """The sheet that a sheet's rows go on in, after `k` full ones. Names have 31 characters at most."""
    return name if not k else f"{name[: 31 - len(f' ~{k + 1}')]} ~{k + 1}"


class Workbook:
    """Sheets of a workbook's bytes or of its file. Rows stream; shared strings are held."""

    def __init__(self, data: bytes | BinaryIO):
        self.zip = zipfile.ZipFile(io.BytesIO(data) if isinstance(data, bytes) else data)
        files = set(self.zip.namelist())
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        self.sheets = {s.get("name"): "xl/" + rels[s.get(f"{_REL}id")].removeprefix("/xl/").lstrip("/") for s in book.iter(f"{_MAIN}sheet")}
        self.epoch_1904 = any(p.get("date1904") in ("1", "true") for p in book.iter(f"{_MAIN}workbookPr"))
        self.strings = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(self.zip.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in files else []
        self.dates: list[bool] = []
        if "xl/styles.xml" in files:
            styles = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
            custom = {int(f.get("numFmtId")) for f in styles.iter(f"{_MAIN}numFmt") if is_date_format(f.get("formatCode") or "")}
            for xf in styles.iterfind(f"{_MAIN}cellXfs/{_MAIN}xf"):
                self.dates.append(int(xf.get("numFmtId") or 0) in _DATE_IDS | custom)

    def _text(self, cell) -> str | None:
        kind, value = cell.get("t"), cell.find(f"{_MAIN}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
        if value is None or value.text is None:
            return None
        if kind == "s":
            return self.strings[int(value.text)]
        if kind == "b":
            return "True" if value.text == "1" else "False"
        if kind in ("str", "e", "d"):
            return value.text
        style = int(cell.get("s") or 0)
        return number_text(float(value.text), style < len(self.dates) and self.dates[style], self.epoch_1904)

    def rows(self, sheet: str) -> Iterator[tuple[int, dict[int, str | None]]]:
        """(row number, values by column) of the rows that have a cell."""
        number = 0
        with self.zip.open(self.sheets[sheet]) as f:
            for _, node in ElementTree.iterparse(f):
                if node.tag == f"{_MAIN}row":
                    number = int(node.get("r") or number + 1)
                    out, at = {}, -1
                    for cell in node.iterfind(f"{_MAIN}c"):
                        at = _column(cell.get("r")) if cell.get("r") else at + 1
                        out[at] = self._text(cell)
                    node.clear()
                    yield number, out

    def header(self, sheet: str) -> list[str]:
        first = next(self.rows(sheet), (1, {}))[1]
        width, names, seen = max(first, default=-1) + 1, [], {}
        for k in range(width):
            name = first.get(k) or f"Unnamed: {k}"
            n = seen.get(name, 0)
            seen[name] = n + 1
            names.append(f"{name}.{n}" if n else name)
        return names


@contextmanager
def _book(path: str) -> Iterator[Workbook]:
    if "://" in path or path.startswith("file:"):
        from pyarrow import fs

        store, inner = (fs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if path.startswith("file:") else fs.FileSystem.from_uri(path)
        with store.open_input_file(inner) as f:
            yield opened(f)
    else:
        with open(path, "rb") as f:
            yield opened(f)


class XlsxSource(DataSource):
    """Options: path, sheet (the first by default), and continued, the data rows of a full
    sheet, with which the sheets that it goes on in are part of it, a task each, and rows count on.
    Columns are text, after `__row`."""

    @classmethod
    def name(cls) -> str:
        return "eventfold_xlsx"

    def schema(self) -> StructType:
        with _book(self.options["path"]) as book:
            sheet = self.options.get("sheet") or next(iter(book.sheets))
            return StructType([StructField("__row", IntegerType()), *(StructField(c, StringType()) for c in book.header(sheet))])

    def reader(self, schema: StructType) -> DataSourceReader:
        return XlsxReader(self.options["path"], self.options.get("sheet"), len(schema) - 1, int(self.options.get("continued", 0)))


class XlsxReader(DataSourceReader):
    def __init__(self, path: str, sheet: str | None, width: int, full: int):
        self.path, self.sheet, self.width, self.full = path, sheet, width, full
    def partitions(self) -> list[InputPartition]:
        with _book(self.path) as book:
            first = self.sheet or next(iter(book.sheets))
            names = [first]
            while self.full and continued(first, len(names)) in book.sheets:
                names.append(continued(first, len(names)))
        return [InputPartition((name, k)) for k, name in enumerate(names)]

    def read(self, partition) -> Iterator[tuple]:
        sheet, k = partition.value
        with _book(self.path) as book:
            for i, (number, cells) in enumerate(book.rows(sheet)):
                if i and any(v is not None for v in cells.values()):
                    yield (number + k * self.full, *(cells.get(c) for c in range(self.width)))

def register(spark: SparkSession) -> None:
    spark.dataSource.register(XlsxSource)


def sheet_names(spark: SparkSession, path: str) -> list[str]:
    with _book(str(path)) as book:
        return list(book.sheets)


# Fills of the two bands and of the header, and column widths by header.
FILLS = ("FFEAF2FB", "FFFFF8E7")
HEADER_FILL, HEADER_FONT = "FF1F4E78", "FFFFFFFF"
WIDE, MEDIUM = {"市民诉求", "回复内容", "事实认定", "解决方式"}, {"诉求标题", "事发地点", "所属部门", "处理部门"}
WIDTHS = {"事件名称": 42, "数据侧": 12} | dict.fromkeys(WIDE, 60) | dict.fromkeys(MEDIUM, 34)


def width_of(header: str) -> int:
    return WIDTHS.get(header, max(12, min(24, len(header) * 2 + 4)))


def _cell(column: int, row: int, value, style: int) -> str:
    if value is None:
        return f'<c r="{_name(column)}{row}" s="{style}"/>'
    text = escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(value)))
    return f'<c r="{_name(column)}{row}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


def row_xml(line: int, band: int, values: list) -> bytes:
    """A data row; its band gives the fill."""
    return (f'<row r="{line}">' + "".join(_cell(k, line, v, 2 + band % len(FILLS)) for k, v in enumerate(values)) + "</row>").encode()


def sheet_ends(headers: list[str], last: int) -> tuple[str, str]:
    """What stands before a sheet's data rows and after them; the header is frozen and filtered."""
    columns = "".join(f'<col min="{k}" max="{k}" width="{width_of(h)}" customWidth="1"/>' for k, h in enumerate(headers, 1))
    head = f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><cols>{columns}</cols><sheetData><row r="1" ht="30" customHeight="1">' + "".join(_cell(k, 1, h, 1) for k, h in enumerate(headers)) + "</row>"
    return head, f'</sheetData><autoFilter ref="A1:{_name(len(headers) - 1)}{max(last, 2)}"/></worksheet>'


def frame_parts(names: list[str]) -> dict[str, str]:
    """The parts of a workbook beside its sheets."""
    fills = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="{c}"/></patternFill></fill>' for c in (HEADER_FILL, *FILLS))
    top = '<alignment vertical="top" wrapText="1"/>'
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml."
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    parts = range(1, len(names) + 1)
    return {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>' + f'<Override PartName="/xl/workbook.xml" ContentType="{kind}sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}worksheet+xml"/>' for i in parts) + "</Types>",
        "_rels/.rels": f'{pack}<Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/_rels/workbook.xml.rels": pack + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in parts) + f'<Relationship Id="rId0" Type="{rel}/styles" Target="styles.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(parts, names, strict=True)) + "</sheets></workbook>",
        "xl/styles.xml": (
            f'<styleSheet xmlns="{_MAIN[1:-1]}"><fonts count="2"><font/><font><b/><color rgb="{HEADER_FONT}"/></font></fonts>'
            f'<fills count="5"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fills}</fills>'
            '<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="4"><xf/>'
            '<xf fontId="1" fillId="2" applyFill="1" applyFont="1"><alignment horizontal="center" vertical="center" wrapText="1"/></xf>'
            f'<xf fillId="3" applyFill="1">{top}</xf><xf fillId="4" applyFill="1">{top}</xf></cellXfs></styleSheet>'
        ),
    }


def write(path: str, sheets: dict[str, tuple[list[str], Iterable[tuple[int, list]]]]) -> None:
    """Writes a small workbook of rows that the caller holds: for each sheet its headers and rows of
    (band, values); cells are text. Frames are written by `xlsx_sink`."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in frame_parts(list(sheets)).items():
            z.writestr(name, text)
        for i, (headers, rows) in enumerate(sheets.values(), 1):
            lines = [row_xml(k, band, values) for k, (band, values) in enumerate(rows, 2)]
            head, tail = sheet_ends(headers, len(lines) + 1)
            z.writestr(f"xl/worksheets/sheet{i}.xml", head.encode() + b"".join(lines) + tail.encode())
