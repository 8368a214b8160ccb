"""Spacing of outcomes and their admission to one timeline, case by case."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from storkline.operators import outcomes

DAY0 = date(2019, 1, 1)
SPACED = ("person_id long, outcome_group string, visit_date date, concept_id long, category string, "
          "gest_value int, value_as_number double")
GROUPS = ["LB", "SB", "ECT", "AB", "DELIV"]


def limits(spark, days=60, **special):
    rows = [(a, b, special.get(f"{a}_{b}", days)) for a in GROUPS for b in GROUPS]
    return spark.createDataFrame(rows, "first_preg_category string, outcome_preg_category string, min_days int")


def visits(spark, *rows):
    """(person, category, day) rows."""
    data = [(p, "AB" if c == "SA" else c, DAY0 + timedelta(d), i, c, None, None) for i, (p, c, d) in enumerate(rows)]
    return spark.createDataFrame(data, SPACED)


def kept(df):
    return sorted((r.person_id, r.category, (r.visit_date - DAY0).days) for r in df.collect())


def test_gap_counts_from_the_visit_before_even_if_dropped(spark):
    rows = [(1, "SB", 0), (1, "SB", 50), (1, "SB", 100), (2, "SB", 0), (2, "SB", 59), (3, "SB", 0), (3, "SB", 60)]
    spaced = outcomes.spaced_visits(outcomes.visit_gaps(visits(spark, *rows)), limits(spark))
    assert kept(spaced) == [(1, "SB", 0), (2, "SB", 0), (3, "SB", 0), (3, "SB", 60)]


@pytest.mark.parametrize(
    ("rows", "stays"),
    [
        ([("SB", 0)], [0]),  # alone
        ([("LB", 0), ("SB", 59)], []),  # too soon after
        ([("LB", 0), ("SB", 60)], [60]),
        ([("SB", 0), ("LB", 59)], []),  # too soon before
        ([("SB", 0), ("LB", 60)], [0]),
        ([("LB", 0), ("SB", 60), ("LB", 119)], []),  # one side too near
        ([("LB", 0), ("SB", 60), ("LB", 120)], [60]),
        ([("SB", 0), ("SB", 100), ("SB", 200)], [0, 100, 200]),  # other candidates only
        ([("LB", 0), ("SB", 500), ("SB", 1000)], [1000]),  # placed on one side, candidate on the other
        ([("LB", 0), ("SB", 0)], []),  # same day
    ],
)
def test_admission_of_stillbirth(spark, rows, stays):
    df = outcomes.admit_through(visits(spark, *[(1, c, d) for c, d in rows]), limits(spark), "SB")
    assert [d for _, c, d in kept(df) if c == "SB"] == stays


def test_spontaneous_abortion_follows_the_abortion_gaps(spark):
    rows = [(1, "ECT", 0), (1, "SA", 70), (2, "ECT", 0), (2, "SA", 80), (3, "LB", 0), (3, "SA", 70)]
    df = outcomes.admit_through(visits(spark, *rows), limits(spark, ECT_AB=80), "AB")
    assert kept(df) == [(1, "ECT", 0), (2, "ECT", 0), (2, "SA", 80), (3, "LB", 0), (3, "SA", 70)]


def test_each_group_is_tested_against_all_placed_before(spark):
    rows = [(1, "LB", 0), (1, "SB", 100), (1, "ECT", 130), (1, "AB", 300), (1, "DELIV", 320)]
    df = outcomes.admit_through(visits(spark, *rows), limits(spark))
    assert kept(df) == [(1, "AB", 300), (1, "LB", 0), (1, "SB", 100)]


def test_start_bounds_count_back_the_terms(spark):
    terms = spark.createDataFrame([("LB", 161, 301, 28)], "category string, min_term int, max_term int, retry int")
    df = outcomes.start_bounds(visits(spark, (1, "LB", 400), (1, "SB", 800)), terms)
    rows = {r.category: r for r in df.collect()}
    assert rows["LB"].min_start_date == DAY0 + timedelta(400 - 161)
    assert rows["LB"].max_start_date == DAY0 + timedelta(400 - 301)
    assert rows["SB"].max_start_date is None


def test_one_row_per_day_is_the_same_for_any_input_order(spark):
    rows = [(1, "SA", 0), (1, "AB", 0), (1, "AB", 5)]
    coded = visits(spark, *rows).drop("outcome_group").withColumns(
        {"concept_name": F.lit("x"), "data_partner_id": F.lit(1)}
    )
    first = kept(outcomes.outcome_visits(coded, "AB"))
    again = kept(outcomes.outcome_visits(coded.orderBy(F.col("concept_id").desc()), "AB"))
    assert first == again == [(1, "AB", 0), (1, "AB", 5)]


# each cell of the threshold table: the group placed before or after, the new one, and the limit that decides
CELLS = [
    ("before", "LB", "SB", "LB_SB"), ("after", "LB", "SB", "SB_LB"),
    ("before", "LB", "ECT", "LB_ECT"), ("before", "SB", "ECT", "LB_ECT"), ("after", "LB", "ECT", "ECT_LB"), ("after", "SB", "ECT", "ECT_SB"),
    ("before", "LB", "AB", "LB_AB"), ("before", "SB", "AB", "LB_AB"), ("before", "ECT", "AB", "ECT_AB"),
    ("after", "LB", "AB", "AB_LB"), ("after", "SB", "AB", "AB_SB"), ("after", "ECT", "AB", "AB_ECT"),
    ("before", "LB", "DELIV", "LB_DELIV"), ("before", "SB", "DELIV", "LB_DELIV"), ("before", "ECT", "DELIV", "ECT_DELIV"),
    ("before", "AB", "DELIV", "ECT_DELIV"), ("after", "LB", "DELIV", "DELIV_LB"), ("after", "SB", "DELIV", "DELIV_SB"),
    ("after", "ECT", "DELIV", "DELIV_ECT"), ("after", "AB", "DELIV", "DELIV_ECT"),
]


def test_every_cell_has_its_own_limit(spark):
    """The cell's limit is 100 days and all others 10 (or the other way round): a gap of 50 tells."""
    seen = []
    for large in (True, False):
        for n, (side, placed, new, cell) in enumerate(CELLS):
            own = {f"{a}_{b}": 10 if large else 100 for a in GROUPS for b in GROUPS} | {cell: 100 if large else 10}
            days = {placed: 0, new: 50} if side == "before" else {new: 0, placed: 50}
            timeline = visits(spark, *[(n, c, d) for c, d in days.items()]).withColumn("placed", F.col("outcome_group") == placed)
            gaps = outcomes.limit_days(limits(spark, **own))
            seen.append(outcomes.admit(timeline, new, gaps).filter(F.col("outcome_group") == new).select(
                F.lit(large).alias("large"), F.lit(n).alias("n"), "placed"))
    from functools import reduce

    for r in reduce(lambda a, b: a.unionByName(b), seen).collect():
        assert r.placed != r.large, CELLS[r.n]


def test_two_term_rules_for_a_category_fail(spark):
    terms = spark.createDataFrame([("LB", 161, 301, 28), ("LB", 160, 301, 28)], "category string, min_term int, max_term int, retry int")
    with pytest.raises(Exception, match="more than one term rule"):
        outcomes.start_bounds(visits(spark, (1, "LB", 400)), terms).collect()
