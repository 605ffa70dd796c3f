"""Queries over tables larger than the bundled ones, and what keeps their parts bounded."""

import pytest
from pyspark.sql import functions as F

from eventfold import schemas
from eventfold.engine import Engine
from eventfold.operators import sync
from eventfold.plans import roundtrips
from eventfold.sources import files, xlsx, xlsx_sink
from eventfold.sources.store import Store


@pytest.fixture(scope="module")
def many_customers(spark, tmp_path_factory):
    """More customers than an upload may have rows by default."""
    folder = str(tmp_path_factory.mktemp("many"))
    n = F.col("id")
    rows = spark.range(files.MAX_ROWS + 1).select(n.alias("c_custkey"), F.concat(F.lit("Customer#"), n.cast("string")).alias("c_name"), (n % 25).cast("int").alias("c_nationkey"), F.lit("FURNITURE").alias("c_mktsegment"))
    rows.write.parquet(f"{folder}/customer.parquet")
    return folder


def _all_records(found):
    row = found.agg(F.count("*"), F.countDistinct("work_order_id"), F.sum((F.col("source_row") != F.col("work_order_id") + 2).cast("int")), F.count("appeal_text")).first()
    n = files.MAX_ROWS + 1
    return row[0] == row[1] == n and row[2] == 0 and row[3] == n - 2 * (n // 5) - min(n % 5, 2)


def test_csv_records_has_every_row(spark, many_customers):
    assert _all_records(roundtrips.csv_records(spark, many_customers))


def test_csv_records_gb18030_has_every_row(spark, many_customers):
    assert _all_records(roundtrips.csv_records_gb18030(spark, many_customers))


def test_inspection_shows_a_preview(spark, sf_dir):
    """The rows of a preview are part of an inspection (finding 4 of round 3)."""
    assert [r["shown"] for r in roundtrips.file_inspection(spark, sf_dir).collect()] == [1, 1, 1]


@pytest.mark.parametrize("length", [1_000, 1 << 14, 1 << 22, 3 << 30])
def test_ranges_are_few(length):
    """Ranges of 16 kB of a file of gigabytes were hundred thousands of tasks."""
    assert length / roundtrips._range_size(length) <= roundtrips.MOST_RANGES
    assert length <= 1 << 14 or length / roundtrips._range_size(length) > 1


def test_a_full_sheet_goes_on_in_further_ones(spark, sf_dir, tmp_path, monkeypatch):
    want = sorted(map(tuple, roundtrips.workbook_export(spark, sf_dir).collect()))
    monkeypatch.setattr(xlsx_sink, "MOST_ROWS", 100)
    found = roundtrips.workbook_export(spark, sf_dir)
    assert found.rdd.getNumPartitions() > 2 and sorted(map(tuple, found.collect())) == want
    rows = spark.range(250).select(F.col("id").alias("k"), F.lit(0).alias("band"), F.col("id").alias("n"))
    path = xlsx_sink.write(f"file://{tmp_path}/a.xlsx", {"一": (["n"], rows)}, ["k"], "band", spread=True)
    assert xlsx.sheet_names(spark, path) == ["一", "一 ~2", "一 ~3"] and len(set(map(len, (xlsx.continued("x" * 40, k) for k in (1, 11))))) == 1
    assert [tuple(r) for r in files.read_sheet(spark, path, "一", continued=True).orderBy("__row").collect()] == [(k + 2, str(k)) for k in range(250)]
    assert files.read_sheet(spark, path, "一").count() == 100


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_empty_table_moves_no_rows(spark, tmp_path):
    """The first upload and comparisons without overrides were joined with nothing, row by row."""
    store = Store(spark, f"file://{tmp_path}")
    rows = spark.range(5).select(F.col("id").cast("string").alias("record_key"), F.lit("c").alias("comparison_id"))
    none = store.read("overrides", schemas.OVERRIDES)
    assert "Join" not in _plan(rows.join(none.groupBy("comparison_id", "record_key").agg(F.max("seq")), ["comparison_id", "record_key"], "left"))
    assert "Join" not in _plan(rows.join(store.read("work_orders", schemas.WORK_ORDERS).select("record_key"), "record_key", "full_outer"))


@pytest.mark.parametrize("most", [0, 100])
def test_last_rows_of_keys_that_repeat(spark, monkeypatch, most, tmp_path):
    monkeypatch.setattr(sync, "BROADCAST_KEYS", most)
    values = [(f"wo:{k}", k * 10 + n) for k in range(20) for n in range(1 + (k % 7 == 0) * 2)]
    rows = spark.createDataFrame(values, "record_key string, source_row int")
    rows = rows.select(*(F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.PAYLOAD.fields))
    made = Engine(spark, f"file://{tmp_path}")._last_rows(rows, [])
    assert sorted((r["record_key"], r["source_row"]) for r in made.collect()) == sorted((f"wo:{k}", k * 10 + (k % 7 == 0) * 2) for k in range(20))
    single = rows.where("source_row % 10 = 0")
    assert "Aggregate" not in _plan(Engine(spark, f"file://{tmp_path}/b")._last_rows(single, []))
