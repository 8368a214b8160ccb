"""Merging both branches, taking repeats apart, and the final table, case by case."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from storkline.config import Params
from storkline.functions.labels import ethnicity_group, race_ethnicity, race_group
from storkline.operators import merge, metadata

P = Params()
DAY0 = date(2019, 1, 1)
HIP = "person_id long, episode int, visit_date date, estimated_start_date date, gest_date date, category string"
PPS = ("person_id long, person_episode_number int, episode_min_date date, episode_max_date date, "
       "episode_max_date_plus_two_months date, pps_category string, pps_outcome_date date")


def day(n):
    return None if n is None else DAY0 + timedelta(n)


def joined(spark, hip, pps):
    """hip as (episode, start, end), pps as (episode, first, last)."""
    h = spark.createDataFrame([(1, e, day(b), day(a), None, "LB") for e, a, b in hip], HIP)
    q = spark.createDataFrame([(1, e, day(a), day(b), day(b + 60), "LB", day(b)) for e, a, b in pps], PPS)
    return merge.overlap_join(h, q)


def pairs(df):
    return sorted(((r.hip_episode, r.pps_episode) for r in df.collect()), key=str)


@pytest.mark.parametrize(
    ("hip", "pps", "expected"),
    [
        ([(1, 0, 300)], [(1, 50, 280)], [(1, 1)]),
        ([(1, 0, 300)], [(1, 301, 400)], [(1, None), (None, 1)]),
        ([(1, 161, 300)], [(1, 0, 100)], [(1, None), (None, 1)]),
        ([(1, 160, 300)], [(1, 0, 100)], [(1, 1)]),  # touches the two months' tail
        ([(1, 320, 300)], [(1, 250, 280)], [(1, 1)]),  # start after end, each inside
        ([(1, 0, 300)], [(1, 10, 100), (2, 200, 290)], [(1, 2), (None, 1)]),  # the nearest end wins
    ],
)
def test_overlap(spark, hip, pps, expected):
    assert pairs(merge.dedupe_overlaps(joined(spark, hip, pps))) == sorted(expected, key=str)


def test_two_outcome_episodes_in_one_timing_episode(spark):
    df = merge.dedupe_overlaps(joined(spark, [(1, 0, 100), (2, 150, 300)], [(1, 50, 290)]))
    assert pairs(df) == [(1, None), (2, 1)]


def test_equal_distance_prefers_the_longer_timing_episode(spark):
    df = merge.dedupe_overlaps(joined(spark, [(1, 0, 300)], [(1, 100, 290), (2, 250, 310)]))
    assert pairs(df) == [(1, 1)]


def test_equal_distance_prefers_the_later_outcome_episode(spark):
    df = merge.dedupe_overlaps(joined(spark, [(1, 0, 100), (2, 110, 120)], [(1, 50, 110)]))
    assert pairs(df) == [(1, None), (2, 1)]


def test_repeat_flags(spark):
    rows = joined(spark, [(1, 0, 300), (2, 700, 800)], [(1, 10, 100), (2, 200, 290)]).collect()
    got = {(r.hip_episode, r.pps_episode): (r.hip_dup, r.pps_dup) for r in rows}
    assert got == {(1, 1): (1, 0), (1, 2): (1, 0), (2, None): (0, None)}


META = ("hip_outcome_category string, hip_end_date date, pps_outcome_category string, pps_end_date date")


@pytest.mark.parametrize(
    ("hip", "hip_end", "pps", "pps_end", "match", "outcome", "end"),
    [
        ("LB", 100, "LB", 114, 1, "LB", 100),
        ("LB", 100, "LB", 115, 0, "LB", 115),
        ("LB", 100, "SB", 106, 0, "LB", 100),
        ("LB", 100, "SB", 107, 0, "SB", 107),
        ("PREG", 100, "PREG", 900, 1, "PREG", 100),
        ("PREG", 100, "SB", 900, 0, "PREG", 100),
        ("LB", 100, None, None, 0, "LB", 100),
        (None, None, "SB", 900, 0, "SB", 900),
        (None, None, None, None, 0, None, None),
    ],
)
def test_final_outcome(spark, hip, hip_end, pps, pps_end, match, outcome, end):
    df = spark.createDataFrame([(hip, day(hip_end), pps, day(pps_end))], META)
    row = metadata.episode_end(metadata.final_outcome(metadata.outcome_match(df, P), P), P).collect()[0]
    assert (row.outcome_match, row.final_outcome_category, row.inferred_episode_end) == (match, outcome, day(end))


def test_start_precision_term_and_score(spark):
    terms = spark.createDataFrame([("LB", 161, 301, 28)], "category string, min_term int, max_term int, retry int")
    df = spark.createDataFrame(
        [(1, "LB", day(400), None, None, None, 1), (2, "LB", day(400), day(239), 3, "week", 0),
         (3, "LB", day(400), day(240), 3, "week", 1), (4, "PREG", day(400), day(99), 3, "week", 0),
         (5, "PREG", day(400), day(98), 3, "week", 0), (6, "XX", day(400), None, None, None, 0)],
        "person_id int, final_outcome_category string, inferred_episode_end date, inferred_episode_start date, "
        "precision_days int, precision_category string, outcome_match int")
    df = metadata.preterm(metadata.concordance(metadata.term_flag(metadata.fill_start(df, terms), P)), P)
    got = {r.person_id: (r.gestational_age_days_calculated, r.precision_days, r.precision_category,
                         r.term_duration_flag, r.outcome_concordance_score, r.preterm_status_from_calculation)
           for r in df.collect()}
    assert got == {
        1: (301, 140, "non-specific", 1, 2, 0), 2: (161, 3, "week", 1, 1, 1), 3: (160, 3, "week", 0, 0, 1),
        4: (301, 3, "week", 1, 1, 0), 5: (302, 3, "week", 0, 0, 0), 6: (None, None, "non-specific", 0, 0, 0),
    }


@pytest.mark.parametrize(
    ("race", "ethnicity", "expected"),
    [
        ("Korean", "Not Hispanic or Latino", "Asian Non-Hispanic"),
        ("Black", None, "Black Non-Hispanic"),
        ("Polynesian", None, "Native Hawaiian or Other Pacific Islander Non-Hispanic"),
        ("Unknown", None, "Unknown"), (None, None, "Unknown"), ("White", None, "White Non-Hispanic"),
        ("Hispanic", None, "Hispanic or Latino Any Race"), ("White", "Hispanic or Latino", "Hispanic or Latino Any Race"),
        ("Something", None, "Other Non-Hispanic"),
    ],
)
def test_race_and_ethnicity(spark, race, ethnicity, expected):
    df = spark.createDataFrame([(race, ethnicity)], "r string, e string")
    label = race_ethnicity(race_group(F.col("r")), ethnicity_group(F.col("e"), F.col("r")))
    assert df.select(label).collect()[0][0] == expected
