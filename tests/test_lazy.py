"""What a listing doesn't read isn't written."""

from eventfold.engine import Engine
from eventfold.plans import service
from eventfold.sources.store import Scratch


def test_pages_write_no_members(spark, sf_dir, monkeypatch):
    labels, staged, compared, compare = [], Scratch.staged, [], Engine.compare
    monkeypatch.setattr(Scratch, "staged", lambda self, df, label="step": labels.append(label) or staged(self, df, label))
    monkeypatch.setattr(Engine, "compare", lambda self, **given: compared.append(given) or compare(self, **given))
    monkeypatch.setattr(service, "_MADE", {})
    pages = service.deep_pages(spark, sf_dir).collect()
    assert len(pages) == 180
    assert "summaries" in labels and "members" not in labels and len(compared) == 1
    rows = service.member_snapshots(spark, sf_dir).collect()
    assert {r["event_id"] for r in rows} == set(range(11, 31)) and labels.count("members") == 1
    both = {r["comparison"]: (r["n"], r["least"], r["greatest"]) for r in service.event_comparisons(spark, sf_dir).collect()}
    n = both["first"][0]
    assert both == {"first": (n, 1, n), "second": (n, n + 1, 2 * n)} and len(compared) == 2
    assert service.deep_pages(spark, sf_dir).collect() == pages
