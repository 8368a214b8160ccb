"""Runs of gestational weeks, their attachment to outcomes, and the clean-up, case by case."""

from datetime import date, timedelta

import pytest

from storkline.config import Params
from storkline.operators import gestation, reconcile

DAY0 = date(2019, 1, 1)
P = Params()
TRAITS = "data_partner_id int, year_of_birth int, race_concept_name string, ethnicity_concept_name string"
GEST = f"person_id long, visit_date date, gest_value int, {TRAITS}"
OUTCOME = ("person_id long, visit_date date, category string, concept_id long, concept_name string, min_term int, "
           f"max_term int, retry int, min_start_date date, max_start_date date, {TRAITS}")
TERMS = {"LB": (161, 301, 28), "AB": (42, 168, 14)}


def day(n):
    return None if n is None else DAY0 + timedelta(n)


def number(d):
    return None if d is None else (d - DAY0).days


def runs(spark, *rows):
    """(person, day, week) rows as numbered runs."""
    df = spark.createDataFrame([(p, day(d), w, 1, 1980, "r", "e") for p, d, w in rows], GEST)
    return gestation.gestation_episodes(gestation.gestation_days(df, P), P)


def starts(df):
    return [(number(r.visit_date), r.episode) for r in df.orderBy("person_id", "visit_date").collect()]


@pytest.mark.parametrize(
    ("second", "episode"),
    [
        ((69, 10), 1), ((70, 10), 2),  # same week, short and long gap
        ((69, 5), 1), ((70, 5), 2),  # falling week
        ((7 * 5 + 27, 15), 1), ((7 * 5 + 28, 15), 2),  # rising week, in time and late
    ],
)
def test_new_run(spark, second, episode):
    assert starts(runs(spark, (1, 0, 10), (1, *second))) == [(0, 1), (second[0], episode)]


def test_week_bounds_and_ties(spark):
    df = runs(spark, (1, 0, 0), (1, 1, 44), (1, 2, 45), (1, 3, 9), (1, 3, 12), (1, 3, 12))
    assert [(number(r.visit_date), r.gest_week) for r in df.orderBy("visit_date").collect()] == [(1, 44), (3, 12)]


def test_bounds_of_a_run(spark):
    row = gestation.gestation_bounds(runs(spark, (1, 0, 10), (1, 20, 8), (1, 30, 8), (1, 40, 20), (1, 50, 20))).collect()[0]
    assert (number(row.first_gest_date), row.first_gest_week, number(row.end_gest_date), row.end_gest_week) == (0, 10, 50, 20)
    assert (row.min_gest_week, number(row.min_gest_date), number(row.min_gest_date_2)) == (8, 20, 30)
    assert (row.max_gest_week, number(row.max_gest_date)) == (20, 40)


def outcome_rows(spark, *rows):
    data = []
    for p, d, c in rows:
        lo, hi, retry = TERMS[c]
        data.append((p, day(d), c, 1, "n", lo, hi, retry, day(d - lo), day(d - hi), 1, 1980, "r", "e"))
    return spark.createDataFrame(data, OUTCOME)


def attach(spark, outcomes, weeks):
    bounds = gestation.gestation_bounds(runs(spark, *weeks))
    return reconcile.attach_gestation(outcome_rows(spark, *outcomes), bounds, P)


def shown(df):
    return sorted((r.category, number(r.outcome_date), number(r.max_gest_date)) for r in df.collect())


@pytest.mark.parametrize(
    ("gest", "joined"),
    [
        ((980, 38), True),  # inside the outcome's term
        ((1028, 30), True), ((1029, 48 - 8), True),  # ends up to or beyond 28 days after
        ((990, 44), True),  # around the earliest start
        ((600, 10), False),  # long before
        ((1300, 20), False),  # long after
    ],
)
def test_attachment(spark, gest, joined):
    got = shown(attach(spark, [(1, 1000, "LB")], [(1, *gest)]))
    alone = [("LB", 1000, None), ("PREG", None, gest[0])]
    assert got == ([("LB", 1000, gest[0])] if joined else alone)


def test_one_side_only(spark):
    got = shown(attach(spark, [(1, 1000, "LB")], [(2, 500, 20)]))
    assert got == [("LB", 1000, None), ("PREG", None, 500)]


def test_nearest_outcome_keeps_the_run_and_ties_stay(spark):
    near = reconcile.clean_episodes(attach(spark, [(1, 1000, "AB"), (1, 1030, "AB")], [(1, 1010, 15)]), P)
    assert shown(near) == [("AB", 1000, 1010)]
    tied = reconcile.clean_episodes(attach(spark, [(1, 1000, "AB"), (1, 1020, "AB")], [(1, 1010, 15)]), P)
    assert shown(tied) == [("AB", 1000, 1010), ("AB", 1020, 1010)]


def test_outcomes_that_do_not_fit_are_removed(spark):
    over = reconcile.clean_episodes(attach(spark, [(1, 1000, "AB")], [(1, 990, 30)]), P).collect()[0]
    assert (over.category, over.removed_category, over.removed_outcome, over.concept_id) == ("PREG", "AB", 1, None)
    assert over.visit_date == day(990)
    at28 = reconcile.clean_episodes(attach(spark, [(1, 1000, "LB")], [(1, 1028, 40)]), P).collect()[0]
    at29 = reconcile.clean_episodes(attach(spark, [(1, 1000, "LB")], [(1, 1029, 40)]), P).collect()[0]
    assert (at28.category, at29.category, at29.visit_date) == ("LB", "PREG", day(1029))


def test_overlaps(spark):
    # a run without outcome that the next episode overlaps goes; a later outcome is moved past retry
    weeks = [(1, 800, 20), (2, 700, 10)]
    df = reconcile.remove_overlaps(reconcile.clean_episodes(
        attach(spark, [(1, 1200, "LB"), (2, 1000, "AB"), (2, 1160, "LB")], weeks), P))
    got = {(r.person_id, r.category): number(r.estimated_start_date) for r in df.collect()}
    assert got[(1, "LB")] == 1200 - 301
    assert got[(1, "PREG")] == 800 - 140  # ends before the outcome's earliest start
    assert got[(2, "LB")] == 1000 + 14  # after the abortion's retry period


def test_overlapped_runs_are_dropped_in_one_pass(spark):
    chain = [(1, 700, 20), (1, 800, 20), (1, 900, 20), (2, 700, 20), (2, 900, 20)]
    df = reconcile.remove_overlaps(reconcile.clean_episodes(attach(spark, [(3, 1000, "LB")], chain), P))
    got = sorted((r.person_id, number(r.max_gest_date)) for r in df.filter("category = 'PREG'").collect())
    assert got == [(1, 900), (2, 700), (2, 900)]


def test_length_counts_from_the_first_gestation_day_inside(spark):
    hip = spark.createDataFrame(
        [(1, "LB", day(300), day(0), 1), (2, "LB", day(300), day(0), 1), (3, "LB", day(300), None, 1),
         (4, "LB", day(300), day(0), 1)],
        "person_id long, category string, visit_date date, estimated_start_date date, episode int")
    gest = spark.createDataFrame(
        [(1, day(-5)), (1, day(0)), (1, day(40)), (2, day(301)), (3, day(10)), (4, day(300))],
        "person_id long, visit_date date")
    got = {r.person_id: (number(r.gest_date), r.episode_length) for r in reconcile.episode_lengths(hip, gest).collect()}
    assert got == {1: (0, 300), 2: (None, 1), 3: (None, 1), 4: (300, 1)}
