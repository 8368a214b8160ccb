"""Concept statistics from loads against those from all events at once."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from checks.fixture import PARAMS, load
from storkline.operators import loads, prevalence
from storkline.plans.pipeline import Pipeline

SF_DIR = "/root/testdata/sf0.001"
EVENT = "person_id long, concept_id long, domain string, concept_name string, event_date string, record_id long"


def events(spark, *rows):
    return spark.createDataFrame(list(rows), EVENT).withColumn("event_date", F.col("event_date").cast("date"))


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


OLD = [(1, 7, "condition", "a", "2001-05-01", 4), (1, 8, "drug", "b", None, 1), (None, 7, "condition", "a", "2001-01-01", 9)]
NEW = [(1, 7, "drug", "a", "2001-05-01", 2), (1, 7, "condition", "c", "2000-01-01", 8), (2, 7, "condition", None, "2002-01-01", None),
       (1, None, None, None, None, None)]


def test_loads_add_up_in_any_order_and_number(spark, tmp_path):
    whole = rows(prevalence.person_concepts(events(spark, *OLD, *NEW)))
    for name, parts in {"ab": (OLD, NEW), "ba": (NEW, OLD), "aba": (OLD, NEW, OLD), "overlap": (OLD + NEW[:2], NEW)}.items():
        folder = str(tmp_path / name)
        for i, part in enumerate(parts):
            loads.add_load(events(spark, *part), folder, f"load-{i}")
        assert rows(prevalence.earliest(loads.read_loads(spark, folder))) == whole, name


def test_a_late_load_moves_the_earliest_record(spark, tmp_path):
    folder = str(tmp_path)
    loads.add_load(events(spark, OLD[0]), folder, "1")
    loads.add_load(events(spark, NEW[1]), folder, "2")
    (row,) = prevalence.earliest(loads.read_loads(spark, folder)).collect()
    assert (str(row.visit_date), row.concept_name) == ("2000-01-01", "c")


def test_a_load_sent_again_replaces_and_a_broken_one_does_not_count(spark, tmp_path):
    folder = str(tmp_path)
    with pytest.raises(ValueError, match="no finished load"):
        loads.read_loads(spark, folder)
    loads.add_load(events(spark, *OLD), folder, "a")
    loads.add_load(events(spark, *NEW), folder, "b")
    (tmp_path / "b" / "_SUCCESS").unlink()  # as a driver leaves it that dies while it writes
    assert rows(loads.read_loads(spark, folder)) == rows(prevalence.first_records(events(spark, *OLD)))
    loads.add_load(events(spark, *NEW), folder, "b")
    assert rows(loads.read_loads(spark, folder)) == rows(prevalence.first_records(events(spark, *OLD, *NEW)))
    loads.add_load(events(spark, OLD[1]), folder, "a")
    assert rows(loads.read_loads(spark, folder)) == rows(prevalence.first_records(events(spark, OLD[1], *NEW)))


def test_empty_loads_names_and_compaction(spark, tmp_path):
    folder, one = str(tmp_path / "many"), str(tmp_path / "one")
    loads.add_load(events(spark, *OLD).limit(0), folder, "none")
    assert loads.read_loads(spark, folder).count() == 0
    loads.add_load(events(spark, *OLD), folder, "a")
    loads.add_load(events(spark, *NEW), folder, "b")
    loads.compact(spark, folder, one, "upto-b")
    assert rows(loads.read_loads(spark, one)) == rows(loads.read_loads(spark, folder))
    loads.add_load(events(spark, (3, 1, "condition", "n", "1999-01-01", 5)), one, "c")
    assert loads.read_loads(spark, one).count() == loads.read_loads(spark, folder).count() + 1
    for bad in ("", "../a", "a/b", "_a"):
        with pytest.raises(ValueError, match="named by"):
            loads.add_load(events(spark, *OLD), folder, bad)
    with pytest.raises(ValueError, match="new folder"):
        loads.compact(spark, folder, folder + "/", "x")


def test_statistics_follow_new_loads_and_codes_without_events(spark, tmp_path):
    """After the second load the statistics equal those of all events; the event table is not read."""
    tables, lists = load(spark, SF_DIR)
    folder = str(tmp_path)
    for name, when in (("first", "record_id % 3 = 0"), ("second", "record_id % 3 <> 0")):
        loads.add_load(tables.event.filter(when), folder, name)
    firsts = loads.read_loads(spark, folder)
    no_events = replace(tables, event=tables.event.limit(0))
    whole = Pipeline(tables, lists, PARAMS)
    found = Pipeline(no_events, lists, PARAMS, firsts)
    assert rows(found.specificity) == rows(whole.specificity) and found.specificity.count() > 0
    fewer = replace(lists, initial=lists.initial.filter("concept_id % 64 = 0"))
    changed = rows(Pipeline(no_events, fewer, PARAMS, firsts).prevalence)
    assert changed == rows(Pipeline(tables, fewer, PARAMS).prevalence) != rows(whole.prevalence)


def test_persons_with_code_from_concepts_or_events(spark):
    tables, lists = load(spark, SF_DIR)
    run = Pipeline(tables, lists, PARAMS)
    assert rows(run.coded_persons) == rows(prevalence.persons_with_code(tables.event, run.standard_codes, PARAMS))
    by_record = replace(PARAMS, drug_by_record_id=True)
    other = Pipeline(tables, lists, by_record)
    assert rows(other.coded_persons) == rows(prevalence.persons_with_code(tables.event, run.standard_codes, by_record))
    with pytest.raises(ValueError, match="record ids"):
        Pipeline(tables, lists, by_record, prevalence.first_records(tables.event))
