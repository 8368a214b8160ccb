"""Start inference against a plain recomputation of the rules on random evidence, and single cases."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest

from storkline.config import Params
from storkline.functions.labels import precision_label
from storkline.operators import start_dates as sd

P = Params()
DAY0 = date(2019, 1, 1)
EVIDENCE = ("person_id long, episode_number int, event_date date, concept_id long, gt_type string, domain_value int, "
            "extrapolated_preg_start date, min_pregnancy_start date, max_pregnancy_start date")


def rows_of(episode, weeks, ranges):
    """Weeks as (value, start day), ranges as (first, last) day."""
    out = [(1, episode, DAY0 + timedelta(i), i, "GW", v, DAY0 + timedelta(s), None, None) for i, (v, s) in enumerate(weeks)]
    out += [(1, episode, DAY0 + timedelta(i), 100 + i, "GR3m", None, None, DAY0 + timedelta(b), DAY0 + timedelta(a))
            for i, (a, b) in enumerate(ranges)]
    return out


def infer(spark, episodes):
    data = [row for n, (weeks, ranges) in enumerate(episodes) for row in rows_of(n, weeks, ranges)]
    df = sd.infer_start(sd.evidence_lists(spark.createDataFrame(data, EVIDENCE)), P)
    return {
        r.episode_number: (None if r.inferred_episode_start is None else (r.inferred_episode_start - DAY0).days,
                           r.precision_days, r.intervals_count, r.majority_overlap_count)
        for r in df.collect()
    }


def core_of(ranges):
    touching = {}
    for i, (a, b) in enumerate(ranges):
        touching[i] = sum(1 for k, (c, d) in enumerate(ranges) if k != i and (a <= c <= b or a <= d <= b))
    q1, q3 = np.quantile(list(touching.values()), [0.25, 0.75])
    limit = abs(q1 - 1.5 * (q3 - q1))
    order = sorted(touching, key=lambda i: (-touching[i], ranges[i]))
    good = [ranges[i] for i in order if (touching[i] != 0 if limit == 0 else touching[i] >= limit)] or [ranges[order[0]]]
    lo, hi = good[0]
    for a, b in good[1:]:
        if lo < b < hi:
            hi = b
        if lo < a < hi:
            lo = a
    return min(a for a, _ in good), max(b for _, b in good), lo, hi


def without_far(starts):
    middle = sorted(starts)[len(starts) // 2]
    away = [abs(s - middle) for s in starts]
    q1, q3 = np.quantile(away, [0.25, 0.75])
    return [s for s, d in zip(starts, away, strict=True) if q1 - 1.5 * (q3 - q1) <= d <= q3 + 1.5 * (q3 - q1)]


def recompute(weeks, ranges):
    starts = [s for _, s in sorted(((-v, i), s) for i, (v, s) in enumerate(weeks))]
    core = core_of(ranges) if ranges else None
    if core:
        first, last, lo, hi = core
        middle = lo + math.floor((hi - lo) / 2)
        if hi - lo < 7:
            lo, hi = middle - 3, middle + 3
    if not starts:
        return middle, last - first, 0, 0
    inside = [s for s in starts if core and lo <= s <= hi]
    majority = len(inside) / len(starts) > 0.5
    good = without_far(inside if majority else starts)
    spread = max(good) - min(good)
    return good[0], -1 if len(good) == 1 and not majority else spread, int(core is not None), int(majority)


def test_random_evidence(spark):
    rng, episodes = random.Random(11), []
    while len(episodes) < 400:
        weeks = [(rng.randint(1, 43), rng.choice([0, 1, 2, 7, 14, 30, 60, rng.randint(-100, 200)]))
                 for _ in range(rng.choice([0, 0, 1, 2, 3, 6, 9]))]
        ranges = []
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):
            a = rng.choice([0, 10, 20, 40, rng.randint(-90, 120)])
            ranges.append((a, a + rng.choice([0, 3, 7, 30, 61, 91])))
        if weeks or ranges:
            episodes.append((weeks, ranges))
    got = infer(spark, episodes)
    for n, (weeks, ranges) in enumerate(episodes):
        assert got[n] == recompute(weeks, ranges), (weeks, ranges)


@pytest.mark.parametrize(
    ("weeks", "ranges", "expected"),
    [
        ([], [(0, 30)], (15, 30, 0, 0)),  # one range: its middle, its length
        ([(20, 5)], [], (5, -1, 0, 0)),  # one week alone is weakly supported
        ([(20, 5)], [(0, 30)], (5, 0, 1, 1)),  # one week in the core is not
        ([(20, 5), (30, 90)], [(0, 30)], (90, 85, 1, 0)),  # half inside is no majority
        ([(20, 5), (30, 90), (10, 9)], [(0, 30)], (5, 4, 1, 1)),  # two of three are
        ([], [(10, 13)], (11, 3, 0, 0)),  # odd length halves downwards
        ([(20, 8)], [(10, 13)], (8, 0, 1, 1)),  # a short core is widened by 3 days around its middle
        ([(20, 7)], [(10, 13)], (7, -1, 1, 0)),
    ],
)
def test_single_cases(spark, weeks, ranges, expected):
    assert infer(spark, [(weeks, ranges)])[0] == expected


def test_one_sided_range_counts_as_a_week(spark):
    row = (1, 0, DAY0, 1, "GR3m", None, None, DAY0 + timedelta(4), None)
    df = sd.infer_start(sd.evidence_lists(spark.createDataFrame([row], EVIDENCE)), P).collect()[0]
    assert (df.inferred_episode_start, df.precision_days, df.gw_flag, df.gr3m_flag) == (DAY0 + timedelta(4), -1, 0, 1)


def test_values_types_and_duplicates(spark):
    event = spark.createDataFrame(
        [
            (1, "condition", 1, "Gestation period, 10 weeks", None, None),
            (1, "condition", 1, "Gestation period, 12 weeks", None, None),
            (1, "observation", 3048230, "age", None, "|text_result_val:30 weeks"),
            (1, "observation", 3048230, "age", None, "about 30"),
            (1, "measurement", 3002209, "age", 39.7, None),
            (1, "measurement", 3002209, "age", 44.0, None),
            (1, "measurement", 50, "scan", 5.0, None),
            (1, "condition", 50, "scan", None, None),
            (1, "drug", 50, "scan", None, None),
            (1, "condition", 60, "other", None, None),
        ],
        "person_id long, domain string, concept_id long, concept_name string, value_as_number double, value_as_string string",
    ).selectExpr("*", "DATE'2019-06-01' AS event_date")
    ages = spark.createDataFrame([(3048230,), (3002209,)], "concept_id long")
    months = spark.createDataFrame([(50, "scan", 2.0, 3.0)], "domain_concept_id long, domain_concept_name string, "
                                   "min_month double, max_month double")
    records = sd.timing_records(event, ages, months)
    assert records.count() == 8
    timed = sd.with_months(sd.week_start(sd.week_value(records, P), ages, P), months)
    values = sorted((r.concept_id, r.domain_value) for r in timed.collect() if r.domain_value is not None)
    assert values == [(1, 10), (1, 12), (50, 5), (3002209, 39), (3002209, 44), (3048230, 30)]
    kept = sd.dedupe_evidence(sd.range_bounds(sd.classify(timed), P)).collect()
    got = sorted((r.gt_type, r.rollup_name, r.domain_value) for r in kept if r.domain_value is not None)
    assert got == [("GR3m", "Gestation Week", 5), ("GW", "Gestation Week", 39)]
    scan = [r for r in kept if r.domain_value is None][0]
    assert (scan.min_pregnancy_start, scan.max_pregnancy_start) == (date(2019, 4, 1), date(2019, 3, 2))


def test_precision_labels(spark):
    df = spark.createDataFrame([(d,) for d in (-1, 0, 7, 8, 14, 21, 22, 28, 29, 56, 57, 84, 85, None)], "d int")
    from pyspark.sql import functions as F
    got = [r[0] for r in df.select(precision_label(F.col("d"))).collect()]
    assert got == ["week_poor-support", "week", "week", "two-week", "two-week", "three-week", "month", "month",
                   "two-month", "two-month", "three-month", "three-month", "non-specific", "non-specific"]
