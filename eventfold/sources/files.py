"""Spreadsheet exports as record tables: format dispatch, encodings, header mapping, limits."""

from __future__ import annotations

import functools
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..schemas import RECORD
from . import csv_scan, encodings, xlsx, xlsx_sink
from .store import Scratch

FORMATS = ("xlsx", "xls", "csv")
#: Data rows of an uploaded file, unless the caller sets another limit.
MAX_ROWS = 200_000


class UnsupportedFileFormatError(ValueError):
    pass


class RowLimitExceededError(ValueError):
    pass


@dataclass(frozen=True)
class SheetInspection:
    name: str
    columns: list[str]
    row_count: int
    preview: list[dict]
    suggested_mapping: dict[str, str | None]


@dataclass(frozen=True)
class FileInspection:
    path: str
    format: str
    sheets: list[SheetInspection]
    total_rows: int
    encoding: str | None = None


def format_of(path: str) -> str:
    found = re.search(r"\.([^./\\]+)$", str(path))
    kind = found[1].lower() if found else ""
    if kind not in FORMATS:
        raise UnsupportedFileFormatError(f"unsupported file format: {kind or 'no extension'}")
    return kind


def encoding_of(spark: SparkSession, path: str) -> str:
    """A file's encoding by Python's name, from pieces of all of it."""
    return encodings.detect(encodings.sample(spark, path))


#: Python's names of encodings that Java knows by another, and those that are read in ranges.
CHARSETS = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "gb18030": "GB18030", "big5": "Big5", "shift_jis": "Shift_JIS", "euc_kr": "EUC-KR", "euc_jp": "EUC-JP", "windows-1252": "windows-1252"}


def scan_csv(spark: SparkSession, path: str, encoding: str | None = None, *, max_rows: int | None = None, owner: Scratch | None = None) -> csv_scan.Scan:
    """A file's data rows, all columns as text under their verbatim headers, with their numbers;
    usual tokens for missing values are null. Many tasks read ranges of the file (of one in UTF-16
    a single task), also where quoted cells hold line feeds. Bytes that aren't of the encoding are
    an error, wherever they stand. More than `max_rows` rows are one too. What is written on the way
    belongs to `owner`, or to the result."""
    encoding = encoding or encoding_of(spark, path)
    if encoding not in ("utf-8", "utf-8-sig"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    if encoding in CHARSETS:
        found = csv_scan.scan(spark, path, CHARSETS[encoding], most=max_rows, check=check_rows, owner=owner)
    else:
        owner = owner or Scratch(spark)
        frame = spark.read.csv(str(path), header=True, inferSchema=False, encoding=encoding, **csv_scan.OPTIONS)
        frame = frame.toDF(*(c.lstrip("\ufeff") for c in frame.columns)).coalesce(1).withColumn("__row", (F.monotonically_increasing_id() + 2).cast("int"))
        frame = owner.staged(frame.repartition("__row"), "records")
        total = frame.count()
        if max_rows is not None:
            check_rows([total], max_rows)
        found = csv_scan.Scan(frame, total, 1, owner)
    columns = [c for c in found.frame.columns if c != "__row"]
    found.frame = found.frame.select("__row", *(null_tokens(F.col(f"`{c}`")).alias(c) for c in columns))
    return found


def read_csv(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    return scan_csv(spark, path, encoding).frame.drop("__row")


def null_tokens(c: Column) -> Column:
    return F.when(~c.isin(*rules.NULL_TOKENS), c)


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None, *, continued: bool = False) -> DataFrame:
    """One sheet (the first by default) as text columns and `__row`, its row number; if it is
    `continued` with the sheets that it goes on in, as a workbook of ours has them."""
    xlsx.register(spark)
    options = ({"sheet": sheet} if sheet else {}) | ({"continued": str(xlsx_sink.MOST_ROWS)} if continued else {})
    frame = spark.read.format("eventfold_xlsx").options(**options).load(str(path))
    return frame.select("__row", *(null_tokens(F.col(f"`{c}`")).alias(c) for c in frame.columns if c != "__row"))


def normal_header(name: str) -> str:
    return re.sub(r"[\s_\-()（）]+", "", str(name)).casefold()


def suggest_mapping(columns: list[str]) -> dict[str, str | None]:
    """For each field the column with the first of its names; of equal headers the last column."""
    there = {normal_header(c): c for c in columns}
    return {name: next((there[normal_header(a)] for a in aliases if normal_header(a) in there), None) for name, aliases in rules.FIELD_ALIASES.items()}


def inspect(spark: SparkSession, path: str, *, encoding: str | None = None, preview_rows: int = 5) -> FileInspection:
    kind = format_of(path)
    if preview_rows < 0:
        raise ValueError("preview_rows must not be negative")
    if kind == "csv":
        encoding = encoding or encoding_of(spark, path)
        found = scan_csv(spark, path, encoding)
        frames = [("CSV", found.frame, found.total)]
    else:
        frames = [(name, read_sheet(spark, path, name), None) for name in xlsx.sheet_names(spark, path)]
    sheets = []
    for name, f, total in frames:
        shown = [r.asDict() for r in f.orderBy("__row").limit(preview_rows).drop("__row").collect()]
        columns = [c for c in f.columns if c != "__row"]
        sheets.append(SheetInspection(name, columns, f.count() if total is None else total, shown, suggest_mapping(columns)))
    return FileInspection(str(path), kind, sheets, sum(s.row_count for s in sheets), encoding if kind == "csv" else None)


def inspection(spark: SparkSession, path: str, *, preview_rows: int = 5) -> DataFrame:
    """`inspect` as a table, a row a sheet: format, sheet, n, columns, id_column, encoding, shown (the
    rows of its preview)."""
    kind, encoding = format_of(path), None
    if preview_rows < 0:
        raise ValueError("preview_rows must not be negative")
    if kind == "csv":
        encoding = encoding_of(spark, path)
        frames = {"CSV": scan_csv(spark, path, encoding).frame}
    else:
        frames = {name: read_sheet(spark, path, name) for name in xlsx.sheet_names(spark, path)}
    rows = []
    for name, f in frames.items():
        names = [c for c in f.columns if c != "__row"]
        preview = f.orderBy("__row").limit(preview_rows).collect()
        given = {"format": kind, "sheet": name, "columns": len(names), "id_column": suggest_mapping(names)["work_order_id"], "encoding": encoding, "shown": len(preview)}
        rows.append(f.agg(F.count("*").alias("n")).select("n", *(F.lit(v).cast("int" if k in ("columns", "shown") else "string").alias(k) for k, v in given.items())))
    return functools.reduce(DataFrame.unionByName, rows)


def check_rows(counts: list[int], most: int) -> int:
    """The sum of the counts, which may not exceed `most`."""
    if most <= 0:
        raise ValueError("max_rows must be positive")
    if sum(counts) > most:
        raise RowLimitExceededError(f"{sum(counts)} rows exceed the limit of {most}")
    return sum(counts)


def within_limit(frames: list[DataFrame], most: int) -> DataFrame:
    """One row: whether the frames have `most` rows or fewer together. Of each no more rows are
    counted than it takes to see the limit broken."""
    if most <= 0:
        raise ValueError("max_rows must be positive")
    some = functools.reduce(DataFrame.union, (f.limit(most + 1).select(F.lit(1)) for f in frames))
    return some.agg((F.count("*") <= most).alias("within"))


def check_limit(df: DataFrame, most: int) -> DataFrame:
    """`df` itself, after reading no more rows than it takes to see the limit broken."""
    check_rows([df.limit(most + 1).count()], most)
    return df


def records(frame: DataFrame, row: Column) -> DataFrame:
    """Rows of schemas.RECORD from a table of text columns under source headers."""
    columns = [c for c in frame.columns if c != "__row"]
    mapping = suggest_mapping(columns)
    missing = [name for name in rules.REQUIRED_FIELDS if not mapping[name]]
    if missing:
        raise ValueError(f"no column found for required fields: {', '.join(missing)}")
    kept = [c for c in columns if c.strip() != rules.JUNK_COLUMN]
    raw = F.map_from_arrays(F.array(*(F.lit(c) for c in kept)), F.array(*(F.col(f"`{c}`").cast("string") for c in kept)))
    fields = [(F.col(f"`{mapping[f.name]}`") if mapping[f.name] else F.lit(None)).cast("string").alias(f.name) for f in RECORD.fields if f.name in mapping]
    return frame.select(row.cast("int").alias("source_row"), *fields, raw.alias("raw_fields")).select(*RECORD.fieldNames()).to(RECORD)


def load_records(spark: SparkSession, path: str, *, max_rows: int | None = MAX_ROWS, owner: Scratch | None = None) -> DataFrame:
    """A file's records; data rows count from 2, after the header. More than `max_rows` data rows
    are an error, unless it is None."""
    if format_of(path) == "csv":
        frame = scan_csv(spark, path, max_rows=max_rows, owner=owner).frame
    else:
        frame = read_sheet(spark, path)
        if max_rows is not None:
            check_limit(frame, max_rows)
        frame = frame.repartition("__row")
    return records(frame, F.col("__row"))


def business_columns(frames: list[list[str]]) -> list[str]:
    """Headers of all files, each once, in order of appearance."""
    return list(dict.fromkeys(c for columns in frames for c in columns if c and c.strip() != rules.JUNK_COLUMN))


def land(spark: SparkSession, path: str, folder: str | None = None) -> tuple[str, str]:
    """A file's copy in `folder`, under its name after a new id (without a folder the file
    itself), and the SHA-256 of its bytes. Bytes stream through; they are never held whole."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    source = jvm.org.apache.hadoop.fs.Path(str(path))
    store, kept = source.getFileSystem(conf), str(path)
    if folder is not None:
        target = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{uuid.uuid4().hex}_{source.getName()}")
        there = target.getFileSystem(conf)
        there.mkdirs(target.getParent())
        if not jvm.org.apache.hadoop.fs.FileUtil.copy(store, source, there, target, False, conf):
            raise OSError(f"{path} could not be copied")
        source, store, kept = target, there, target.toString()
    stream = store.open(source)
    try:
        return kept, jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def length(spark: SparkSession, path: str) -> int:
    """Bytes of a file."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).getLen()


def join(spark: SparkSession, folders: list[str], path: str) -> str:
    """The part files of folders that Spark wrote, in their order, as one file. Bytes stream through;
    they are never held whole. The folders are removed."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(conf)
    out = store.create(target, False)
    try:
        for folder in folders:
            there = jvm.org.apache.hadoop.fs.Path(folder)
            parts = {f.getPath().getName(): f.getPath() for f in store.listStatus(there) if f.getPath().getName().startswith("part-")}
            for name in sorted(parts):
                part = store.open(parts[name])
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
                finally:
                    part.close()
            store.delete(there, True)
    finally:
        out.close()
    return path
