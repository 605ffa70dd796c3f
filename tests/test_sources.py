"""Files, encodings, header mapping, limits, and the drop folder."""

import struct
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import biff

from eventfold.engine import Engine
from eventfold.sources import files, xlsx
from eventfold.streaming.dropfolder import sync_folder

HEADERS = ["工单编号 ", "受理时间", "诉求标题", "事项分类四级", "市民诉求"]


def rows(n, start=0):
    return [[f"WO-{i}", "2026-01-01", f"标题{i}", "劳动纠纷", f"诉求,{i}\n第二行"] for i in range(start, start + n)]


def csv_bytes(data, encoding):
    quote = lambda v: '"' + v.replace('"', '""') + '"'
    return "\n".join(",".join(map(quote, r)) for r in [HEADERS, *data]).encode(encoding)


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "gb18030"])
def test_csv(spark, tmp_path, encoding):
    path = tmp_path / "a.csv"
    path.write_bytes(csv_bytes(rows(2), encoding))
    found = files.inspect(spark, str(path), preview_rows=1)
    assert (found.total_rows, found.encoding, found.sheets[0].columns) == (2, encoding, HEADERS)
    assert found.sheets[0].preview[0]["诉求标题"] == "标题0" and found.sheets[0].suggested_mapping["work_order_id"] == "工单编号 "
    records = files.load_records(spark, str(path)).orderBy("source_row").collect()
    assert [(r["source_row"], r["work_order_id"], r["category_level_4"]) for r in records] == [(2, "WO-0", "劳动纠纷"), (3, "WO-1", "劳动纠纷")]
    assert records[0]["appeal_text"] == "诉求,0\n第二行" and records[0]["raw_fields"]["工单编号 "] == "WO-0"


def test_xlsx_round_trip(spark, tmp_path):
    path = str(tmp_path / "b.xlsx")
    xlsx.write(path, {"A表": (HEADERS, [(0, r) for r in rows(2)]), "B表": (HEADERS, [(1, r) for r in rows(3)])})
    found = files.inspect(spark, path)
    assert [(s.name, s.row_count) for s in found.sheets] == [("A表", 2), ("B表", 3)] and found.total_rows == 5
    assert [r["work_order_id"] for r in files.load_records(spark, path).orderBy("source_row").collect()] == ["WO-0", "WO-1"]


def test_mapping():
    got = files.suggest_mapping(["工单号", "受理日期", "工单标题", "事项分类一级", "事项分类四级", "事项分类", "投诉内容", "备注"])
    assert (got["work_order_id"], got["received_at"], got["title"], got["category"], got["appeal_text"], got["location"]) == ("工单号", "受理日期", "工单标题", "事项分类", "投诉内容", None)
    assert set(files.suggest_mapping(["其他列"]).values()) == {None}
    assert files.suggest_mapping(["标题", "标 题"])["title"] == "标 题"
    assert files.business_columns([["a", "b"], ["b", "Unnamed: 37", "c"]]) == ["a", "b", "c"]


def test_limits_and_formats(spark, tmp_path):
    assert files.check_rows([2, 3], 5) == 5
    with pytest.raises(files.RowLimitExceededError):
        files.check_rows([2, 3], 4)
    with pytest.raises(files.UnsupportedFileFormatError, match="txt"):
        files.format_of("input.txt")
    path = tmp_path / "c.csv"
    path.write_bytes(csv_bytes(rows(3), "utf-8"))
    with pytest.raises(files.RowLimitExceededError):
        files.load_records(spark, str(path), max_rows=2)
    path.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="appeal_text"):
        files.load_records(spark, str(path))


def cell(kind, row, column, body, style=0):
    return biff.record(kind, struct.pack("<HHH", row, column, style) + body)


@pytest.mark.parametrize("many", [0, 400])
def test_binary_workbook(spark, tmp_path, many):
    strings = [*HEADERS, "WO-1", "标题一", "诉求,一\n第二行", *(f"更多{i}" for i in range(many))]
    label = lambda r, c, k: cell(0xFD, r, c, struct.pack("<I", k))
    rk = lambda v, flag: struct.pack("<I", ((v << 2) | flag) & 0xFFFFFFFF)
    rows = [label(0, c, c) for c in range(5)] + [label(1, 0, 5), cell(0x203, 1, 1, struct.pack("<d", 46266.5), 1), label(1, 2, 6), label(1, 4, 7)]
    rows += [label(2, 0, 5), cell(0x203, 2, 1, struct.pack("<d", 1.5)), cell(0x27E, 2, 2, rk(1234, 3)), cell(0xBD, 2, 3, b""), cell(0x204, 2, 4, biff.text("plain"))]
    rows[-2] = biff.record(0xBD, struct.pack("<HH", 2, 3) + struct.pack("<HI", 0, (77 << 2) | 2) + struct.pack("<H", 3))
    rows += [cell(0x06, 4, 0, b"\0\0\0\0\0\0\xff\xff" + b"\0" * 8), biff.record(0x207, biff.text("由公式")), cell(0x205, 4, 2, b"\x01\0"), cell(0x205, 4, 3, b"\x2a\x01"), cell(0x06, 4, 4, struct.pack("<d", 8.0) + b"\0" * 8)]
    cut = 8 + sum(len(biff.text(x)) for x in strings[:6]) + 3 + 2  # after the first character of 标题一
    data = biff.compound(biff.workbook({"表一": rows, "空": []}, strings, formats=[(170, 'yyyy"年"m')], xfs=(0, 170), sst_cut=cut))
    path = tmp_path / "c.xls"
    path.write_bytes(data)
    book = xlsx.opened(data)
    assert list(book.sheets) == ["表一", "空"] and book.strings == strings and list(book.rows("空")) == []
    got = dict(book.rows("表一"))
    assert got[2] == {0: "WO-1", 1: "2026-09-01 12:00:00", 2: "标题一", 4: "诉求,一\n第二行"}
    assert got[3] == {0: "WO-1", 1: "1.5", 2: "12.34", 3: "77", 4: "plain"} and got[5] == {0: "由公式", 2: "True", 3: "#N/A", 4: "8"}
    seen = files.inspect(spark, str(path))
    assert seen.format == "xls" and [(x.name, x.row_count) for x in seen.sheets] == [("表一", 3), ("空", 0)]
    records = files.load_records(spark, str(path)).orderBy("source_row").collect()
    assert [(r["source_row"], r["work_order_id"], r["title"]) for r in records] == [(2, "WO-1", "标题一"), (3, "WO-1", "12.34"), (5, "由公式", "True")]
    assert records[2]["category_level_4"] is None  # '#N/A' is a missing value


def test_landing_and_encodings(spark, tmp_path):
    import hashlib

    path = tmp_path / "up.csv"
    path.write_bytes(csv_bytes(rows(2), "utf-8"))
    kept, digest = files.land(spark, str(path), f"file://{tmp_path}/uploads")
    name = kept.rsplit("/", 1)[-1]
    assert digest == hashlib.sha256(path.read_bytes()).hexdigest() and name.endswith("_up.csv") and len(name) == 32 + len("_up.csv")
    assert (tmp_path / "uploads" / name).read_bytes() == path.read_bytes()
    assert files.land(spark, str(path)) == (str(path), digest)


def test_drop_folder(spark, tmp_path):
    folder = tmp_path / "drop"
    folder.mkdir()
    engine = Engine(spark, f"file://{tmp_path}/store")
    (folder / "1.csv").write_bytes(csv_bytes(rows(2), "utf-8"))
    run = lambda: sync_folder(engine, str(folder), str(tmp_path / "check")).awaitTermination()
    run()
    assert engine.count_current_orders() == 2
    run()
    assert engine.list_sync_runs().count() == 1
    (folder / "2.csv").write_bytes(csv_bytes(rows(2, 1), "utf-8"))
    run()
    assert engine.list_current_orders().where("missing_in_latest_upload").count() == 1
