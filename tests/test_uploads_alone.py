"""Listings of uploads make no comparison."""

from eventfold.engine import Engine
from eventfold.plans import service


def test_uploads_are_listed_without_a_comparison(spark, sf_dir, monkeypatch):
    compared, compare = [], Engine.compare
    monkeypatch.setattr(Engine, "compare", lambda self, **given: compared.append(given) or compare(self, **given))
    monkeypatch.setattr(service, "_MADE", {})
    assert [r["nth"] for r in service.sync_versions(spark, sf_dir).orderBy("nth").collect()] == [1, 2]
    assert service.version_rows(spark, sf_dir).count() and not compared
    assert service.event_lookups(spark, sf_dir).count() == 3 and len(compared) == 1
