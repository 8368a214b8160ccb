"""The pipeline stage by stage against plain versions, each on the stage's own input."""

import re

import pyarrow as pa
import pytest
import sentencepiece

import corpus_pipeline
from storkline.llm.personal_data import by_patterns
from storkline.llm.queries import VOCABULARY
from storkline.llm.rule_ensemble import score

from .test_decontaminate import words
from .test_near_dups import by_all_pairs

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Rows by doc_id before the first and after every stage."""
    docs, found = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        found.append({r.doc_id: r for r in docs.collect()})
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.dtypes == docs.dtypes
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return [*found, {r.doc_id: r for r in docs.collect()}]


def test_quality(spark, steps):
    scored = score(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(steps[1]) == {r.doc_id for r in scored.filter("predicted = 1").collect()}
    assert all(steps[1][i] == steps[0][i] for i in steps[1])


def test_near_duplicates(steps):
    groups = by_all_pairs([(i, r.text) for i, r in steps[1].items()], 5, 80)
    assert set(steps[2]) == {i for i, (_, root) in groups.items() if root == i}
    assert all(steps[2][i] == steps[1][i] for i in steps[2])


def test_decontamination(spark, steps):
    items = [f" {' '.join(words(r.text))} " for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {i for i, r in steps[2].items() if any(x in f" {' '.join(words(r.text))} " for x in items)}
    gone = set(steps[2]) - set(steps[3])
    assert leaks and leaks <= gone and len(gone) <= len(leaks) + 3


def test_personal_data(steps):
    assert set(steps[3]) == set(steps[4])
    assert any(by_patterns(r.text)[0] for r in steps[3].values()) and not any(by_patterns(r.text)[0] for r in steps[4].values())
    assert all(steps[4][i] == r for i, r in steps[3].items() if not re.search("[0-9@]", r.text))


def test_tokens(steps):
    library = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    assert set(steps[4]) == set(steps[5])
    for i, r in steps[5].items():
        assert r.text == steps[4][i].text and r.token_ids == library.encode(r.text)


def test_run_is_all_stages(spark, steps):
    assert {r.doc_id: r.token_ids for r in corpus_pipeline.run(spark, SF).collect()} == {i: r.token_ids for i, r in steps[-1].items()}


def test_odd_rows(spark, odd, tmp_path):
    """Rows with nulls and clashing columns pass through every stage."""
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns[:len(docs.columns)] == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))


def test_workers_get_small_batches(spark):
    """A task holds a batch twice, in the JVM and in the worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(6000, numPartitions=1).selectExpr("id AS doc_id", "repeat('ab ', 700) AS text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.set(key, "64m")
            stage(spark, spark.createDataFrame([(1, "a 1.2.3.4 b")], "doc_id long, text string"), SF)
            found = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
            assert len(found) >= 5 and max(found) < 3 << 20
    finally:
        spark.conf.set(key, before)
