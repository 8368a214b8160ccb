"""Weighted ranks and overlap counts against plain lists."""

import random
import time
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from storkline.functions import spread

DAY0 = date(2019, 1, 1)
RANGES = "ranges array<struct<start:date,end:date,n:bigint>>"


def counts_of(spark, lists):
    df = spark.createDataFrame([([(DAY0 + timedelta(a), DAY0 + timedelta(b), n) for a, b, n in sorted(own)],) for own in lists], RANGES)
    return [
        [((r.start - DAY0).days, (r.end - DAY0).days, r.n, r.overlaps, r.fewer) for r in row.c]
        for row in df.select(spread.overlap_counts(F.col("ranges")).alias("c")).collect()
    ]


def by_pairs(own):
    return [
        (a, b, n, k, -k) for a, b, n in sorted(own)
        for k in [sum(m for c, d, m in own if a <= c <= b or a <= d <= b) - 1]
    ]


@pytest.mark.parametrize("few", [0, 64])
def test_overlap_counts(spark, monkeypatch, few):
    monkeypatch.setattr(spread, "FEW_RANGES", few)
    pick, lists = random.Random(few), [[], [(0, 0, 1)], [(3, 9, 5)]]
    for size in (2, 5, 30, 63, 64, 65, 120):
        for lengths in ((0,), (30, 61), (0, 1, 2, 15, 16, 17, 90)):
            starts = [pick.randrange(-40, 80) for _ in range(size)]
            lists.append([(a, a + length, pick.randrange(1, 4)) for a, length in {(a, pick.choice(lengths)) for a in starts}])
    assert counts_of(spark, lists) == [by_pairs(own) for own in lists]


def test_thousands_of_ranges_take_seconds(spark):
    pick = random.Random(4)
    own = list({(a, a + length): None for a in range(1250) for length in (30, 61, 91, 122)})
    own = [(a, b, pick.randrange(1, 5)) for a, b in own]
    assert len(own) == 5000
    begin = time.monotonic()
    found = counts_of(spark, [own])[0]
    assert time.monotonic() - begin < 20
    first, last, n = (np.array(x) for x in zip(*own, strict=True))
    for a, b, _, k, _ in pick.sample(found, 200):
        assert k == n[((a <= first) & (first <= b)) | ((a <= last) & (last <= b))].sum() - 1


def test_quantiles_and_ranks_carry_multiplicity(spark):
    pick = random.Random(5)
    lists = [[]] + [[(pick.randrange(30), pick.randrange(1, 5)) for _ in range(k)] for k in (1, 2, 3, 7, 40)]
    df = spark.createDataFrame([(own,) for own in lists], "items array<struct<v:int,n:bigint>>")
    ordered = spread.by_value(F.col("items"), "v")
    rows = df.select(*[spread.quantile(ordered, q).alias(f"q{int(100 * q)}") for q in (0.25, 0.5, 0.75)],
                     spread.at_rank(ordered, F.floor(spread.total(ordered) / 2), "int").alias("upper")).collect()
    for own, row in zip(lists, rows, strict=True):
        flat = sorted(v for v, n in own for _ in range(n))
        want = [float(x) for x in np.quantile(flat, [0.25, 0.5, 0.75])] if flat else [None] * 3
        assert [row.q25, row.q50, row.q75] == pytest.approx(want) if flat else [row.q25, row.q50, row.q75] == want
        assert row.upper == (flat[len(flat) // 2] if flat else None)


def test_a_value_may_stand_a_billion_times(spark):
    df = spark.createDataFrame([([(4, 10**9), (10, 3 * 10**9)],)], "items array<struct<v:int,n:bigint>>")
    ordered = spread.by_value(F.col("items"), "v")
    assert df.select(spread.quantile(ordered, 0.2), spread.quantile(ordered, 0.75)).first()[:] == (4.0, 10.0)
