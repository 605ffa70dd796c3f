"""Queries against the same rows from DuckDB."""

import duckdb
import pandas as pd
import pytest

from eventfold.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One query of each kind here; the driver compares all of them.
CHOSEN = [n for n in SQL if not n.startswith(("event_filter_", "event_page_"))] + ["event_filter_combined", "event_filter_completed", "event_page_updated_desc"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def _rows(df):
    return sorted(tuple("null" if pd.isna(v) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", CHOSEN)
def test_same_rows(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_plans_stay_native(spark, sf_dir):
    for name in ("event_summary", "event_filter_combined", "snapshot_diff", "keep_last_dedup"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not any(k in plan for k in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin")), name
