"""Days joined with the intervals that hold them: every pair once, whatever the bins; and heavy persons."""

import random
from collections import Counter
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from storkline.functions.intervals import BIN_BITS, MOST_BINS, join_days

RECORDS, SPANS = "person_id long, day date, record int", "person_id long, first date, last date, span int"


def by_pairs(records, spans, closed):
    return Counter(
        (p, d, r, a, b, s) for p, d, r in records for q, a, b, s in spans
        if p == q and None not in (d, a, b) and (a <= d <= b if closed else a < d < b)
    )


def run(spark, records, spans, closed=True):
    out = join_days(spark.createDataFrame(records, RECORDS), "day", spark.createDataFrame(spans, SPANS), "first", "last", closed=closed)
    assert out.columns == ["person_id", "day", "record", "first", "last", "span"]
    return Counter(map(tuple, out.collect()))


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("some_long", [True, False])
def test_every_pair_once(spark, closed, some_long):
    pick = random.Random(some_long)
    day = lambda: date(1960, 1, 1) + timedelta(pick.randrange(9000))  # noqa: E731 - on both sides of the epoch
    records = [(pick.randrange(4), day(), i) for i in range(600)] + [(1, None, 600), (None, day(), 601)]
    spans = [(pick.randrange(4), a, a + timedelta(pick.choice([-3, 0, 1, 63, 64, 65, 300, 2000])), i) for i in range(80) for a in [day()]]
    spans += [(1, None, day(), 80), (1, day(), None, 81), (None, day(), day(), 82)]
    if some_long:
        spans += [(2, date(1961, 5, 5), date(2999, 1, 1), 83), (3, date(1900, 1, 1), date(1983, 3, 3), 84)]
    found = run(spark, records, spans, closed)
    assert found == by_pairs(records, spans, closed) and sum(found.values()) > 200


def test_edges_of_bins(spark):
    zero = date(1970, 1, 1)
    edges = [k * 2**BIN_BITS + j for k in (-1, 0, 1, 2, MOST_BINS, MOST_BINS + 1) for j in (-1, 0, 1)]
    records = [(1, zero + timedelta(e), i) for i, e in enumerate(edges)]
    spans = [(1, zero + timedelta(a), zero + timedelta(b), i) for i, (a, b) in enumerate((a, b) for a in edges for b in edges)]
    for closed in (True, False):
        assert run(spark, records, spans, closed) == by_pairs(records, spans, closed)


def test_nothing_to_join(spark):
    assert not run(spark, [], [(1, date(2020, 1, 1), date(2020, 2, 1), 1)])
    assert not run(spark, [(1, date(2020, 1, 1), 1)], [])


def test_a_heavy_person_is_spread(spark):
    """One person holds half of all rows; the join's largest task stays near the median."""
    days, parts = 20 * 365, 24
    heavy = spark.range(60_000).select(F.lit(1).cast("long").alias("person_id"), (F.col("id") % days).alias("d"))
    others = spark.range(60_000).select((F.col("id") % 5000 + 2).alias("person_id"), (F.col("id") * 31 % days).alias("d"))
    records = heavy.unionByName(others).select("person_id", F.date_add(F.lit("2000-01-01").cast("date"), F.col("d").cast("int")).alias("day"))
    starts = spark.range(1, 5002).select(F.col("id").alias("person_id"), F.explode(F.sequence(F.lit(0), F.lit(days), F.lit(400))).alias("d"))
    spans = starts.select("person_id", F.date_add(F.lit("2000-01-01").cast("date"), "d").alias("first"), (F.col("d") / 400).cast("int").alias("span"))
    spans = spans.withColumn("last", F.date_add("first", 280))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(parts), "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        tasks = join_days(records, "day", spans, "first", "last").groupBy(F.spark_partition_id().alias("task")).count()
        sizes = sorted(r["count"] for r in tasks.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(sizes) == parts and sizes[-1] < 2 * sizes[parts // 2]
