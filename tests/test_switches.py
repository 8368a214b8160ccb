"""The choices that the rules leave open, each with its switch off and on."""

from dataclasses import replace
from datetime import date

import pytest

from storkline.config import Params
from storkline.operators import merge, prevalence, start_dates, timing

P = Params()


@pytest.mark.parametrize(("on", "persons"), [(False, {1, 3}), (True, {2, 3})])
def test_drugs_match_on_concept_or_record(spark, on, persons):
    event = spark.createDataFrame(
        [(1, "drug", 7, 100), (2, "drug", 8, 7), (3, "condition", 7, 101), (4, "condition", 8, 7)],
        "person_id long, domain string, concept_id long, record_id long")
    codes = spark.createDataFrame([(7,)], "concept_id long")
    found = prevalence.persons_with_code(event, codes, replace(P, drug_by_record_id=on))
    assert {r.person_id for r in found.collect()} == persons


@pytest.mark.parametrize(("on", "kept"), [(False, {1, 2}), (True, {2})])
def test_a_concept_seen_once_has_no_spread(spark, on, kept):
    """Concept 1 has one record in all, concept 2 three near each other in two outcomes."""
    rows = [(1, 1, "LB", 1, 100)] + [(p, 1, c, 2, d) for p, c, d in ((1, "LB", 100), (2, "LB", 110), (3, "SB", 105), (4, "SB", 100))]
    months = spark.createDataFrame(
        [(p, e, c, k, f"n{k}", d, None, 1) for p, e, c, k, d in rows],
        "person_id long, episode int, category string, domain_concept_id long, domain_concept_name string, days int, days_ft int, n_records long")
    denied = spark.createDataFrame([], "concept_id long")
    found = timing.stable_concepts(months, denied, replace(P, drop_single_sample=on, min_share=0.0))
    assert {r.domain_concept_id for r in found.collect()} == kept


@pytest.mark.parametrize(("on", "value"), [(False, 12), (True, None)])
def test_text_result_markers(spark, on, value):
    rows = spark.createDataFrame(
        [("observation", "x", "|text_result_val:12", None), ("observation", "x", "|mapped_text_result_val:12", None)],
        "domain string, concept_name string, value_as_string string, value_as_number double")
    found = start_dates.week_value(rows, replace(P, keep_value_markers=on)).collect()
    assert [r.domain_value for r in found] == [value, value]


@pytest.mark.parametrize(("on", "day"), [(False, None), (True, date(2020, 1, 2))])
def test_category_as_a_whole_or_anywhere_in_the_entry(spark, on, day):
    """The name of a stillbirth concept holds the letters of another category."""
    found = spark.createDataFrame(
        [(1, 1, date(2019, 12, 1), date(2020, 1, 2), 5, "ALBUMIN", "SB", 1)],
        "person_id long, person_episode_number int, episode_min_date date, event_date date, concept_id long, concept_name string, category string, n_records long",
    ).selectExpr("*", "episode_min_date AS episode_max_date", "episode_min_date AS lookback_date", "event_date AS lookahead_date")
    row = merge.first_dates(found, replace(P, category_by_text=on)).first()
    assert row.SB_date == date(2020, 1, 2) and row.LB_date == day
