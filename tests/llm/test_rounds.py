"""Rounds of the components: few shuffles where nodes are few, the same result where they are many."""

import pytest

from eventfold.llm import components as found
from eventfold.llm.common import Steps

PATH = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 130)]


def counted(spark, monkeypatch, broadcast_nodes):
    """The components of PATH, and the mentions of joins by shuffle in the plans of what was written."""
    plans, saved = [], Steps.saved

    def noted(self, df, label="step"):
        plans.append(df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString())
        return saved(self, df, label)

    monkeypatch.setattr(Steps, "saved", noted)
    monkeypatch.setattr(found, "BROADCAST_NODES", broadcast_nodes, raising=False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = {r["node"]: r["component"] for r in found.components(spark.createDataFrame(PATH, "a long, b long").repartition(8)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    return rows, sum(p.count("SortMergeJoin") for p in plans)


@pytest.mark.parametrize("most", [200_000, 0])
def test_rounds(spark, monkeypatch, most):
    rows, joins = counted(spark, monkeypatch, most)
    assert rows == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 130)}
    assert (joins == 0) == (most > 0)
