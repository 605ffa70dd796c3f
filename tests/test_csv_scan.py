"""The scan of one CSV file in ranges, against the standard library's reader."""

import csv
import io
import itertools
import random

import numpy as np
import pytest

from eventfold.sources import csv_scan, files
from eventfold.sources.store import release, scratch_root

WORDS = {"utf-8": ["é", "标题", "한국", "x" * 30, ""], "gb18030": ["標题", "㐀", "镕丂", "aé", ""], "big5": ["標題", "許功蓋", "ab", ""], "shift_jis": ["表示", "ソース", "カナ", "ab", ""], "euc_kr": ["한국", "가나다", "ab", ""]}


@pytest.fixture
def split(spark):
    """Ranges of so many bytes."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}

    def to(n):
        for k in keys:
            spark.conf.set(k, str(n))

    yield to
    for k, v in before.items():
        spark.conf.set(k, v)


def written(rng, n, words, newline):
    """A file's text: quoted and plain cells, blank lines, doubled quotes and quotes within cells."""
    out = []
    for k in range(n):
        cells = []
        for _ in range(4):
            cell = "".join(rng.choice([*words, " ", ",", '"', newline, newline * 2, "\n"]) for _ in range(rng.randint(0, 6)))
            quoted = any(c in cell for c in ",\n\r") or cell.startswith('"') or rng.random() < 0.3
            cells.append('"' + cell.replace('"', '""') + '"' if quoted else cell)
        if not any(cells):
            cells[1] = "z"
        out.append(",".join([str(k), *cells]))
        if rng.random() < 0.1:
            out.append("")
    return newline.join(["n,a,b,a,", *out]) + rng.choice(["", newline])


@pytest.mark.parametrize(("encoding", "newline"), [("utf-8", "\n"), ("utf-8-sig", "\r\n"), ("gb18030", "\n"), ("big5", "\n"), ("shift_jis", "\n"), ("euc_kr", "\r\n")])
def test_same_rows_as_one_reader(spark, tmp_path, split, encoding, newline):
    rng = random.Random(encoding)
    text = written(rng, 300, WORDS[encoding.removesuffix("-sig")], newline)
    path = tmp_path / "a.csv"
    path.write_bytes(text.encode(encoding))
    want = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    assert want[0] == ["n", "a", "b", "a", ""]
    for size in (1 << 20, 700):
        split(size)
        found = files.scan_csv(spark, str(path), encoding)
        assert found.frame.columns == ["__row", "n", "a", "b", "a.1", "Unnamed: 4"]
        got = sorted(tuple(r) for r in found.frame.collect())
        assert [r[0] for r in got] == list(range(2, len(want) + 1)) and found.total == len(want) - 1
        blank = lambda v: None if v in ("", "NA", "nan") else v
        assert [r[1:] for r in got] == [tuple(map(blank, (r + [""] * 5)[:5])) for r in want[1:]]
        assert found.ranges == 1 if size > 10_000 else found.ranges > 10
        found.scratch.release()


def test_states():
    kinds = [(True, False), (True, True), (False, False), (False, True)]
    for lines in itertools.chain(itertools.product(kinds, repeat=4), [()]):
        out, within = (np.array([k[i] for k in lines], bool) for i in range(2))
        for start in (False, True):
            state, want = start, []
            for a, b in lines:
                want.append(state)
                state = not (b if state else a)
            before, after = csv_scan.states(out, within, start)
            assert before.tolist() == want and after == state


def test_a_cell_over_many_ranges(spark, tmp_path, split):
    split(64)
    long = "\n".join(f'line {k} says ""x""' for k in range(200))
    path = tmp_path / "a.csv"
    path.write_text(f'a,b\n1,"{long}"\n\n2,y\n3,"never closed\n4,5', encoding="utf-8")
    got = sorted(tuple(r) for r in files.scan_csv(spark, str(path), "utf-8").frame.collect())
    assert got[:2] == [(2, "1", long.replace('""', '"')), (3, "2", "y")] and len(got) == 3 and got[2][1] == "3"


def test_bytes_of_another_encoding(spark, tmp_path, split):
    path = tmp_path / "a.csv"
    path.write_bytes(b"a,b\n" + b"1,plain\n" * 145_000 + "2,标题\n".encode("gb18030") + b"1,plain\n" * 20_000)
    assert files.encoding_of(spark, str(path)) == "utf-8"  # between two pieces
    with pytest.raises(Exception, match="MALFORMED_CHARACTER_CODING"):
        files.read_csv(spark, str(path)).write.format("noop").mode("overwrite").save()


def test_little_files(spark, tmp_path):
    path = tmp_path / "a.csv"
    for text, columns, rows in (("", [], []), ("\n\n", [], []), ("a,b", ["a", "b"], []), ('"a\nb",\n1\n\n1,2,3\n', ["a\nb", "Unnamed: 1"], [(2, "1", None), (3, "1", "2")])):
        path.write_text(text)
        found = files.scan_csv(spark, str(path))
        assert found.frame.columns == ["__row", *columns] and sorted(tuple(r) for r in found.frame.collect()) == rows
        assert found.total == len(rows)
    with pytest.raises(files.RowLimitExceededError):
        files.scan_csv(spark, str(path), max_rows=1)


def test_release(spark, tmp_path):
    from pathlib import Path

    path = tmp_path / "a.csv"
    path.write_text("a\n1\n")
    found = files.scan_csv(spark, str(path))
    root = Path(scratch_root(spark).removeprefix("file://"))
    before = set(root.iterdir())
    found.scratch.release()
    assert len(before - set(root.iterdir())) == 1
    files.scan_csv(spark, str(path))
    release(spark)
    assert not root.exists()
