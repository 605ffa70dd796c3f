"""Parsing works each value out once, and no pattern is made for a row (findings 20 and 21 of round 3)."""

import random
import re

import pytest
from pyspark.sql import functions as F

from eventfold.functions import rules, text
from eventfold.operators import normalize
from eventfold.plans import roundtrips

PATTERNS = ("regexp_extract(", "regexp_replace(", "regexp_extract_all(", "RLIKE", "split(")


def _most_patterns(df):
    """Patterns of the projection that has most of them."""
    most, open_ = 0, [df._jdf.queryExecution().optimizedPlan()]
    while open_:
        node = open_.pop()
        open_ += [node.children().apply(k) for k in range(node.children().size())]
        shown = [node.expressions().apply(k).toString() for k in range(node.expressions().size())]
        most = max(most, sum(s.count(p) for s in shown for p in PATTERNS))
    return most


def test_each_pattern_runs_once(spark, sf_dir):
    """Numerals of buildings and floors alone were more than 300 patterns a row."""
    assert _most_patterns(roundtrips.parsed_records(spark, sf_dir)) < 40
    rows = spark.createDataFrame([("十二棟",)], "c string").select(text.numbered_component(F.col("c")).alias("c"))
    assert _most_patterns(rows) < 8 and rows.first()[0] == "12栋"


def _without(text_, part, tail):
    at = text_.find(part) if part else -1
    return text_ if at < 0 else text_[:at] + text_[at + len(part) + (text_[at + len(part) : at + len(part) + 1] in (*tail, "\0") if tail else 0) :]


@pytest.mark.parametrize("tail", [(), ("镇", "乡")])
def test_remove_first(spark, tail):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("a镇乡𝒳门.$\\") for _ in range(rng.randint(0, n)))
    rows = [(k, word(9), rng.choice([None, word(2)])) for k in range(300)] + [(300, None, "a"), (301, None, None)]
    out = spark.createDataFrame(rows, "k int, t string, p string").select("k", text.remove_first(F.col("t"), F.col("p"), tail).alias("out"))
    assert "split(" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r["k"]: r["out"] for r in out.collect()} == {k: None if t is None else _without(t, p, tail) for k, t, p in rows}


def test_first_contained_and_components(spark):
    rng = random.Random(4)
    bits = ["江海区", "高新区", "江门市高新区", "路", "东海路12号", "3单元", "12室", "5房", "铺位A-1", "二十楼", "7F", "8f", "号厂房", "3号厂房", "十二棟", "9座", " ", "x", "１２室", "店铺 B", "街7"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 5)))) for k in range(400)] + [(400, None)]
    c = F.col("t")
    guarded = spark.createDataFrame(rows, "k int, t string").select("*", text.region(c).alias("region"), *(v.alias(f"m_{n}") for n, v in text.component_matches(c).items()), *(F.regexp_extract(c, p, 0).alias(f"w_{n}") for n, p in text.PATTERNS.items()))
    known = [(w, w) for w in rules.REGIONS] + list(rules.REGION_ALIASES)
    for r in guarded.collect():
        if r["t"] is not None:
            assert r["region"] == next((name for w, name in known if w in r["t"]), None)
            assert all(r[f"m_{n}"] == r[f"w_{n}"] for n in text.PATTERNS), r


def test_labels_stand_for_a_category(spark):
    given = ["事项一：积水", "前言 事\r项2 : x 事项三:y", "事项：积水", "事项： 事项三: z", "事项三:", None, "", "事项五:x", "事项一 x 事项二:"]
    rows = spark.createDataFrame([(k, g) for k, g in enumerate(given)], "k int, t string")
    out = rows.select("k", text.first_label(F.col("t")).alias("own"), F.get(text.issue_segments(F.col("t")), F.lit(0))["label"].alias("want")).collect()
    assert [r["own"] for r in out] == [r["want"] for r in out] and sum(r["own"] is not None for r in out) >= 3


def test_address_ends_at_the_next_heading(spark):
    given = ["江海区一。事项：x", "；备注 : y", "江海区。\n诉求：a；事项：b", "江海区。", "。x", "。;事项:"]
    rows = spark.createDataFrame([(g,) for g in given], "t string")
    out = rows.select("t", text.address_line(F.col("t"), F.lit(None), F.lit(None))[0].alias("line")).collect()
    assert [r["line"] for r in out] == [re.split(r"[。；;]\s*(?:事项|诉求|备注)\s*[:：]", r["t"], maxsplit=1)[0].strip() for r in out]
    assert "split(" not in normalize.with_parse(rows.select(F.col("t").alias("appeal_text"), F.col("t").alias("title"), F.col("t").alias("location"))).select("p_line")._jdf.queryExecution().optimizedPlan().toString()
