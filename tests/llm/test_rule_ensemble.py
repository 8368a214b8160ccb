"""The rule ensemble: held-out accuracy, compiled rules, odd rows."""

import zlib

import pytest

from storkline.llm import rule_ensemble
from storkline.llm.rule_ensemble import keep_good, score


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels")]


def test_held_out_rows(spark, tables):
    docs, labels = tables
    rows = score(docs, labels).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    out = [(truth[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    good, bad = [s for y, s, _ in out if y], [s for y, s, _ in out if not y]
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad) > 0.95
    assert sum(y == p for y, _, p in out) / len(out) > 0.93
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.predicted}


def test_labels_of_held_out_rows_do_not_matter(spark, tables):
    docs, labels = tables
    turned = labels.withColumn("quality", rule_ensemble.F.when(rule_ensemble.held_out(), 1 - rule_ensemble.F.col("quality")).otherwise(rule_ensemble.F.col("quality")))
    a, b = ({(r.doc_id, r.score) for r in score(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_paths_of_a_printed_tree():
    tree = """DecisionTreeModel
  If (feature 0 <= 2.0)
   If (feature 0 <= 1.0)
    Predict: 0.0
   Else (feature 0 > 1.0)
    Predict: 1.0
  Else (feature 0 > 2.0)
   Predict: 1.0
"""
    name = rule_ensemble.FEATURES[0]
    assert rule_ensemble.paths(tree) == [
        ((name, "<=", 2.0),), ((name, "<=", 1.0),), ((name, "<=", 2.0), (name, ">", 1.0)), ((name, ">", 2.0),),
    ]


def test_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, None), (4, None, 1)], "doc_id long, quality int, toxic int")
    out = score(odd, labels).collect()
    assert len(out) == odd.count() and all(0 < r.score < 1 for r in out)
    assert not any(r.held_out for r in out if r.doc_id is None)
    assert score(nothing, labels).count() == 0
    assert {r.score for r in score(odd, labels.limit(0)).collect()} == {0.5}
    assert keep_good(odd, labels).columns == odd.columns
