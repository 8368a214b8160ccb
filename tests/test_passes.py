"""How often the events are read and moved: once by the steps on episodes, once on the way into episodes."""

import re
from datetime import date

import pytest

from checks.fixture import PARAMS
from checks.queries import QUERIES, Steps
from storkline.operators import loads, prevalence, start_dates, timing

SF_DIR = "/root/testdata/sf0.001"
EVENT = "person_id long, concept_id long, domain string, concept_name string, event_date date, record_id long"


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcasts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_steps_on_episodes_share_the_pass_over_events(spark):
    """The episodes rest on the rows of interest already; the events are not joined and filtered anew."""
    run = Steps(spark, SF_DIR)
    episodes = "person_id long, episode_number int, recorded_episode_start date, recorded_episode_end date"
    windows = ("person_id long, person_episode_number int, episode_min_date date, episode_max_date date, "
               "lookback_date date, lookahead_date date")
    run.__dict__["merged_episodes"] = spark.createDataFrame([(1, 1, date(1996, 1, 1), date(1996, 2, 1))], episodes)
    run.__dict__["windows"] = spark.createDataFrame([(1, 1, *[date(1996, 1, 1)] * 4)], windows)
    for df in (run.time_records, run.time_in, run.bounded, QUERIES["esd_timing_concepts"].build(run), run.candidates):
        assert not [f for f in df.inputFiles() if "lineitem" in f]
    of_events = start_dates.timing_records(run.tables.event, run.lists.timing, run.lists.months)
    assert rows(run.time_records) == rows(of_events) and run.time_records.count() > 0


def found_in_episodes(spark):
    day = date(2000, 1, 20)
    events = [(1, 7, "condition", "a", day, i) for i in range(3)] + [
        (1, 7, "drug", "a", day, 3), (1, 7, "condition", None, day, 4), (1, 8, "condition", "b", day, 5),
        (1, 7, "condition", "a", date(2000, 3, 1), 6), (1, 7, "condition", "a", None, 7), (2, 7, "condition", "a", day, 8),
    ]
    # two that share the day, one that ends on it, one of no definite outcome
    spans = [(1, 1, date(2000, 1, 1), date(2000, 2, 1), "LB"), (1, 2, date(2000, 1, 10), date(2000, 2, 1), "SB"),
             (1, 3, date(2000, 1, 1), day, "LB"), (1, 4, date(2000, 1, 1), date(2000, 2, 1), "PREG")]
    event = spark.createDataFrame(events, EVENT)
    specific = spark.createDataFrame([(7,), (7,)], "concept_id long")
    episodes = spark.createDataFrame(
        spans, "person_id long, episode int, estimated_start_date date, visit_date date, category string")
    return timing.episode_concepts(event, specific, episodes, PARAMS)


def test_equal_records_are_counted_per_episode(spark):
    found = [(r.episode, r.domain, r.domain_concept_name, r.n_records) for r in found_in_episodes(spark).collect()]
    assert sorted(found, key=str) == sorted(
        [(e, *k) for e in (1, 2) for k in (("condition", "a", 3), ("drug", "a", 1), ("condition", None, 1))], key=str)


def test_events_move_once_on_the_way_into_episodes(spark, no_broadcasts):
    text = plan(found_in_episodes(spark))
    join = re.search(r"SortMergeJoin \[person_id#\d+L?, _bin#", text)
    below = text[join.start():]
    assert re.search(r"Exchange hashpartitioning\(person_id#\d+L?, _bin#", below)
    assert "count(1)" in text and "count(1)" not in below


def test_loads_side_by_side_are_gathered_once(spark, tmp_path, no_broadcasts):
    day = date(2001, 5, 1)
    parts = [[(1, 7, "drug", "a", day, 2), (1, 7, "condition", "b", day, 3), (None, 7, "drug", "a", None, None)],
             [(1, 7, "condition", "b", day, 1), (1, 7, "condition", "a", day, 3), (1, 8, "drug", None, day, 4)]]
    folder = str(tmp_path)
    for i, part in enumerate(parts):
        loads.add_load(spark.createDataFrame(part, EVENT), folder, f"load-{i}")
    side = prevalence.earliest(loads.loaded(spark, folder))
    assert rows(side) == rows(prevalence.person_concepts(spark.createDataFrame(sum(parts, []), EVENT)))
    assert rows(side) == rows(prevalence.earliest(loads.read_loads(spark, folder)))
    text = plan(side)
    assert text.count("Exchange ") == 1 and "Sort " not in text[text.index("Exchange "):]


def test_persons_concepts_move_once_for_cases_and_controls(spark, no_broadcasts):
    """They lie by person; joining them with cases and with controls moves the persons only."""
    run = Steps(spark, SF_DIR)
    for df in (run.case_events, run.control_events):
        text = plan(df)
        (scan,) = [line for line in text.splitlines() if "FileScan" in line and "visit_date" in line]
        assert "Bucketed: true" in scan
        above = text[:text.index(scan)].splitlines()
        depth = scan.index("FileScan")
        while above and depth:
            line = above.pop()
            own = len(line) - len(line.lstrip(" :+-"))
            if own < depth:
                assert "Exchange" not in line
                depth = own
    assert {(r.person_id, r.concept_id) for r in run.person_concepts.collect()} == {
        (r.person_id, r.concept_id) for r in run.tables.event.select("person_id", "concept_id").distinct().collect()}
