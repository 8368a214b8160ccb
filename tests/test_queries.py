"""Every registered query against its SQL on the small tables."""

import os

import pytest

from checks.compare import normal, open_oracle, oracle_rows
from checks.queries import QUERIES, Steps

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def steps(spark):
    return Steps(spark, SF_DIR)


@pytest.fixture(scope="module")
def oracle():
    return open_oracle(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(name, steps, oracle):
    query = QUERIES[name]
    df = query.frame(steps)
    columns, rows = oracle_rows(oracle, query.sql())
    assert sorted(df.columns) == sorted(columns)
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal(columns, rows)


@pytest.mark.parametrize(
    ("before", "after"),
    [("split", "short"), ("short", "pps_records"), ("bounded", "evidence_rows"), ("cohort", "gest_visits")],
)
def test_rules_remove_some_rows_and_keep_some(steps, before, after):
    assert 0 < getattr(steps, after).count() < getattr(steps, before).count()


def test_every_record_has_an_agreement(steps):
    assert QUERIES["pps_agreement"].frame(steps).count() == steps.line.count()


def test_stages_follow_each_other(spark):
    """Step 4 on the output of step 2, which runs on the output of step 1."""
    run = Steps(spark, SF_DIR)
    listed = {r.concept_id for r in run.specific_concepts.collect()}
    assert listed and {r.domain_concept_id for r in run.concept_summary.collect()} <= listed


def test_shared_stages_do_not_outlive_a_change_of_the_tables(spark, tmp_path):
    import shutil

    import __spark_entry__

    for name in ("customer", "part", "orders", "lineitem"):
        shutil.copy(f"{SF_DIR}/{name}.parquet", tmp_path / f"{name}.parquet")
    query = __spark_entry__.queries()["concept_lookup"]
    before = query(spark, str(tmp_path)).count()
    (tmp_path / "part.parquet").unlink()
    spark.read.parquet(f"{SF_DIR}/part.parquet").filter("p_partkey < 100").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    assert 0 < query(spark, str(tmp_path)).count() < before
