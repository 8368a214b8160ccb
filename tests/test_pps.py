"""Timing agreement against a plain loop over each person's records, and single cases."""

import random
import time
from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F

from storkline.config import Params
from storkline.operators import merge, pps
from storkline.session import cut

DAY0 = date(2018, 6, 1)
P = Params()
MONTHS = {10: (1.0, 2.0), 11: (3.0, 3.0), 12: (5.0, 7.0), 13: (9.0, 9.0), 14: (0.0, 9.0), 15: (6.0, 6.0)}


def frames(spark, rows):
    """(person, day, concept) rows."""
    data = [(p, DAY0 + timedelta(d), c, f"n{c}", "condition") for p, d, c in rows]
    records = spark.createDataFrame(
        data, "person_id long, event_date date, concept_id long, concept_name string, domain string")
    months = spark.createDataFrame(
        [(c, f"n{c}", lo, hi) for c, (lo, hi) in MONTHS.items()],
        "domain_concept_id long, domain_concept_name string, min_month double, max_month double")
    people = sorted({p for p, *_ in rows})
    person = spark.createDataFrame(
        [(p, "FEMALE", 1980, "r", "e") for p in people],
        "person_id long, gender_concept_name string, year_of_birth int, race_concept_name string, "
        "ethnicity_concept_name string")
    return records, months, person


def by_loop(rows):
    """Episode number of each record, by comparing each with all others."""
    def fit(x, y):
        apart = (x[0] - y[0]) / 30
        lo_x, hi_x = MONTHS[x[1]]
        lo_y, hi_y = MONTHS[y[1]]
        return hi_x - lo_y + 2 >= apart >= lo_x - hi_y - 2

    result = {}
    for person in {p for p, *_ in rows}:
        line = sorted((d, c) for p, d, c in set(rows) if p == person)
        number = 1
        for i, record in enumerate(line):
            if i:
                gap = (record[0] - line[i - 1][0]) / 30
                agrees = any(fit(record, line[j]) for j in range(i)) or any(
                    fit(line[i + b], line[i - b]) for b in range(1, min(i, len(line) - 1 - i) + 1))
                number += (gap > 2 and not agrees) or gap > 10
            result[(person, *record)] = number
    return result


def test_split_equals_the_loop(spark):
    rng = random.Random(7)
    rows = []
    for person in range(250):
        at = 0
        for _ in range(rng.randint(1, 14)):
            at += rng.choice([0, 3, 20, 59, 60, 61, 75, 100, 140, 200, 299, 300, 301, 330])
            rows.append((person, at, rng.choice(list(MONTHS))))
    rows = sorted(set(rows))
    records, months, person = frames(spark, rows)
    split = pps.split_episodes(pps.timeline(records, months, person, P), months, P)
    got = {(r.person_id, (r.event_date - DAY0).days, r.concept_id): r.episode for r in split.collect()}
    assert got == by_loop(rows)
    assert len({n for n in got.values()}) > 3


def test_agreement_is_only_asked_after_undecided_gaps(spark):
    rows = [(1, 0, 10), (1, 60, 13), (2, 0, 10), (2, 61, 13), (3, 0, 10), (3, 301, 13), (4, 0, 10), (4, 90, 12)]
    records, months, person = frames(spark, rows)
    got = {(r.person_id, r.position): r.agrees for r in pps.agreement(
        pps.timeline(records, months, person, P), months, P, pps.undecided(P)).collect()}
    assert got == {(2, 2): False, (4, 2): True}


def test_agreement_of_every_record(spark):
    rows = [(1, 0, 10), (1, 60, 13), (2, 0, 10), (2, 61, 13), (3, 0, 10), (3, 301, 13), (4, 0, 10), (4, 90, 12)]
    records, months, person = frames(spark, rows)
    got = {(r.person_id, r.position): r.agrees for r in pps.agreement(
        pps.timeline(records, months, person, P), months, P).collect()}
    assert got == {(p, n): (p, n) == (4, 2) for p in range(1, 5) for n in (1, 2)}


def by_arrays(line):
    """Agreement of each record of one person's line (day, concept), every pair tried."""
    day = np.array([d for d, _ in line])
    low, high = (np.array([MONTHS[c][k] for _, c in line]) for k in (0, 1))

    def fit(x, y):
        apart = (day[x] - day[y]) / 30
        return (high[x] - low[y] + 2 >= apart) & (apart >= low[x] - high[y] - 2)

    out = []
    for i in range(len(line)):
        b = np.arange(1, min(i, len(line) - 1 - i) + 1)
        out.append(bool(fit(i, np.arange(i)).any() or fit(i + b, i - b).any()))
    return out


def test_agreement_of_mixed_lines(spark):
    """Direct fits, fits around a record and none; ties of days; month ranges of all widths."""
    rng, rows = random.Random(3), []
    for person in range(200):
        at, known = rng.randrange(300), rng.sample(list(MONTHS), rng.randint(1, 4))
        for _ in range(rng.randint(1, 25)):
            at += rng.choice([0, 0, 1, 30, 60, 61, 90, 150, 240, 330, 400])
            rows.append((person, at, rng.choice(known)))
    rows = sorted(set(rows))
    records, months, person = frames(spark, rows)
    got = {(r.person_id, r.position): r.agrees for r in pps.agreement(pps.timeline(records, months, person, P), months, P).collect()}
    want = {}
    for person in {p for p, *_ in rows}:
        for i, agrees in enumerate(by_arrays(sorted((d, c) for p, d, c in rows if p == person))):
            want[person, i + 1] = agrees
    assert got == want and 100 < sum(got.values()) < len(got) - 100


def test_a_person_with_thousands_of_records(spark):
    """Every record asked for; the rows between the operators grow with the records, and it takes seconds."""
    kinds = list(MONTHS)
    line = [(d, c) for d in range(3334) for c in kinds]
    records, months, person = frames(spark, [(1, 0, kinds[0])])
    days = spark.range(3334).select(F.lit(1).cast("long").alias("person_id"), F.date_add(F.lit(DAY0), F.col("id").cast("int")).alias("event_date"))
    records = days.join(months.select(F.col("domain_concept_id").alias("concept_id"), F.col("domain_concept_name").alias("concept_name")), F.lit(True))
    ordered = cut(pps.timeline(records.withColumn("domain", F.lit("condition")), months, person, P))
    assert ordered.count() == len(line) == 20_004
    begin = time.monotonic()
    got = [r.agrees for r in pps.agreement(ordered, months, P).orderBy("position").collect()]
    assert time.monotonic() - begin < 40
    assert got == by_arrays(line)
    base = ordered.select("person_id", "position", "event_date", *pps.RANGES, "records")
    alone = pps.fits_earlier(ordered, base, months, P).filter(~F.col("fits"))
    assert 0 < alone.count() < 50  # only those meet other records in pairs


def test_long_episodes_go_and_the_rest_is_renumbered(spark):
    data = [(1, DAY0, 1), (1, DAY0 + timedelta(361), 1), (1, DAY0 + timedelta(800), 2), (1, DAY0 + timedelta(1160), 2),
            (1, DAY0 + timedelta(1600), 3)]
    df = pps.drop_long_episodes(spark.createDataFrame(data, "person_id long, event_date date, episode int"), P)
    assert sorted((r.event_date, r.episode) for r in df.collect()) == [
        (data[2][1], 1), (data[3][1], 1), (data[4][1], 2)]


def test_persons_with_too_many_episodes_go(spark):
    data = [(1, DAY0 + timedelta(i * 70), i + 1) for i in range(6)] + [(2, DAY0 + timedelta(365), 1)]
    df = pps.drop_frequent_persons(spark.createDataFrame(data, "person_id long, event_date date, episode int"), P)
    assert {r.person_id for r in df.collect()} == {2}


def test_search_window_and_outcome_priority(spark):
    bounds = spark.createDataFrame(
        [(1, 1, DAY0, DAY0 + timedelta(100), 4.0, 5.0), (1, 2, DAY0 + timedelta(200), DAY0 + timedelta(250), 9.0, 9.0)],
        "person_id long, episode int, first date, event_date date, min_month double, max_month double")
    rows = bounds.drop("first").unionByName(
        bounds.drop("event_date").withColumnRenamed("first", "event_date"))
    windows = merge.search_windows(pps.episode_bounds(rows, P), P)
    got = {r.person_episode_number: (r.lookback_date, r.lookahead_date) for r in windows.collect()}
    assert got[1] == (DAY0 + timedelta(86), DAY0 + timedelta(199))  # day before the next episode
    assert got[2][1] == date(2019, 4, 6)  # 11 - 9 months after the last record
    codes = spark.createDataFrame([(1, "a", "SA"), (2, "b", "LB"), (3, "c", "DELIV"), (4, "d", "PREG")],
                                  "concept_id long, concept_name string, category string")
    event = spark.createDataFrame(
        [(1, DAY0 + timedelta(90), 1, "a"), (1, DAY0 + timedelta(150), 2, "b"), (1, DAY0 + timedelta(140), 3, "c"),
         (1, DAY0 + timedelta(240), 3, "c"), (1, DAY0 + timedelta(241), 4, "d"), (1, DAY0 + timedelta(242), 2, None)],
        "person_id long, event_date date, concept_id long, concept_name string").selectExpr("*", "'condition' AS domain")
    picked = merge.pick_outcome(merge.first_dates(merge.outcome_candidates(event, codes, windows), P))
    got = {r.person_episode_number: (r.pps_category, (r.pps_outcome_date - DAY0).days) for r in picked.collect()}
    assert got == {1: ("LB", 150), 2: ("DELIV", 240)}
