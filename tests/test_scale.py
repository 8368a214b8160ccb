"""What must hold on a large cluster: plan shapes, skewed persons, and input order."""

import re
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from checks.fixture import PARAMS, load
from checks.queries import QUERIES, Steps
from storkline.operators import pps
from storkline.plans.pipeline import Pipeline

SF_DIR = "/root/testdata/sf0.001"
ROOT = Path(__file__).parent.parent / "storkline"


@pytest.fixture(scope="module")
def steps(spark):
    return Steps(spark, SF_DIR)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_python_workers_and_no_pairs_without_key(steps, name):
    text = plan(QUERIES[name].frame(steps))
    assert not re.search(r"EvalPython|InPandas|InArrow|CartesianProduct|BroadcastNestedLoopJoin", text)


def test_library_does_not_gather_on_the_driver():
    banned = r"\.collect\(\)|toPandas|\.toLocalIterator|localCheckpoint|crossJoin|\.rdd\b|\.foreach\("
    for path in ROOT.rglob("*.py"):
        if path.parent.name == "llm":
            continue  # gathers bounded models and says so there
        assert not re.search(banned, path.read_text()), path


def test_outcome_timeline_gathers_persons_once(spark, steps):
    steps.evidence  # built before broadcasts are switched off
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(steps.admitted("DELIV"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    by_person = [line for line in text.splitlines() if re.search(r"Exchange hashpartitioning\(person_id#\d+L?, \d+\)", line)]
    assert len(by_person) == 2  # the visits and the person table
    assert text.count("WindowGroupLimit") == 2  # visits are limited per group before their shuffle


def test_scan_reads_only_what_it_needs(steps):
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan(steps.with_code))
    assert not any("l_extendedprice" in r or "l_quantity" in r for r in read)


def test_stage_filters_reach_the_scan(steps):
    text = plan(steps.hip_episodes.filter(F.col("episode") == 1).select("person_id"))
    assert "PushedFilters: [IsNotNull(episode), EqualTo(episode,1)]" in text
    assert "ReadSchema: struct<person_id:bigint,episode:int>" in text


def test_hot_person_and_input_order_do_not_matter(spark):
    """One person with far more than a third of all rows, rows in any order: same final table."""
    tables, lists = load(spark, SF_DIR)
    hot = tables.event.groupBy("person_id").count().orderBy(F.desc("count")).first()["person_id"]
    copies = F.when(F.col("person_id") == hot, F.sequence(F.lit(0), F.lit(149))).otherwise(F.array(F.lit(0)))
    many = (
        tables.event.withColumn("_copy", F.explode(copies))
        .withColumn("record_id", F.col("record_id") * 1000 + F.col("_copy"))
        .drop("_copy")
        .orderBy(F.rand(3))
    )
    assert many.filter(F.col("person_id") == hot).count() * 3 > many.count()
    plain = Pipeline(tables, lists, PARAMS).episodes
    skewed = Pipeline(replace(tables, event=many), lists, PARAMS).episodes
    key = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert key(plain) == key(skewed)


def test_event_table_is_reduced_without_a_sort(steps):
    """Between the scan and the first exchange of the earliest records stands a hash aggregate only."""
    text = plan(steps.per_person)
    below = text[text.rindex("Exchange hashpartitioning(person_id"):]
    assert "HashAggregate" in below and "Sort" not in below.replace("SortMergeJoin", "")


def test_rows_meet_few_undecided_records(spark):
    """A dense person: pairs formed grow with the records, not with their square."""
    days = spark.range(0, 20).selectExpr("explode(sequence(0, 40)) AS d", "id").selectExpr(
        "1L AS person_id", "date_add(DATE'2000-01-01', cast(id * 110 + d AS int)) AS event_date")
    codes = spark.range(1, 6).selectExpr("id AS concept_id")
    rows = days.join(codes, F.lit(True)).selectExpr(
        "*", "concat('n', concept_id) AS concept_name", "'condition' AS domain")
    months = spark.range(1, 6).selectExpr(
        "id AS domain_concept_id", "concat('n', id) AS domain_concept_name", "cast(id AS double) AS min_month",
        "cast(id AS double) AS max_month")
    person = spark.createDataFrame(
        [(1, "FEMALE", 1980, "r", "e")],
        "person_id long, gender_concept_name string, year_of_birth int, race_concept_name string, "
        "ethnicity_concept_name string")
    line = pps.timeline(rows, months, person, PARAMS)
    found = pps.agreement(line, months, PARAMS, pps.undecided(PARAMS))
    assert line.count() == 20 * 41 * 5
    assert found.count() == 19  # one undecided record per gap
    assert {r.agrees for r in found.collect()} == {True}


