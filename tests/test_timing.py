"""Moments of gestation months: exact at any count, and the same however they are put together."""

import random
from decimal import Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from storkline.operators.timing import add_moments, from_moments, month_moments


def by_decimals(rows):
    with localcontext() as c:
        c.prec = 60
        n = sum(Decimal(k) for _, k in rows)
        mean = sum(Decimal(d) * k for d, k in rows) / n
        variance = sum((Decimal(d) - mean) ** 2 * k for d, k in rows) / (n - 1)
        return float(mean / 30), float(variance.sqrt() / 30)


@pytest.mark.parametrize("count", [1, 1000, 10**9, 10**12])
def test_against_decimals(spark, count):
    pick = random.Random(count)
    rows = [(d, pick.randrange(1, 4) * count) for d in (200_000, 200_001, 200_001, 200_002)]
    df = spark.createDataFrame(rows, "days int, n_records long")
    out = df.agg(*month_moments("days")).select(*from_moments("m", "s")).first()
    assert out[:] == pytest.approx(by_decimals(rows), rel=1e-12)


def test_parts_put_together(spark):
    pick = random.Random(2)
    rows = [(pick.randrange(5), pick.choice([None, *range(-30, 300)]), pick.randrange(1, 9)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "part int, days int, n_records long")
    whole = df.agg(*month_moments("days")).select(*from_moments("m", "s")).first()
    parts = df.groupBy("part").agg(*month_moments("days")).agg(*add_moments()).select(*from_moments("m", "s")).first()
    assert whole == parts and whole[:] == pytest.approx(by_decimals([(d, k) for _, d, k in rows if d is not None]))


def test_one_or_no_day(spark):
    df = spark.createDataFrame([("one", 40, 1), ("none", None, 3)], "k string, days int, n_records long")
    out = {r.k: (r.m, r.s) for r in df.groupBy("k").agg(*month_moments("days")).select("k", *from_moments("m", "s")).collect()}
    assert out == {"one": (40 / 30, None), "none": (None, None)}
    assert df.filter(F.lit(False)).agg(*month_moments("days")).select(*from_moments("m", "s")).first()[:] == (None, None)
