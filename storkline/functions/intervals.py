"""Joins of days with the intervals that hold them.

A key alone would put all rows of a heavy person into one task and try each of its days against each of
its intervals. Time is cut into bins instead: an interval stands in every bin it touches, a day in one,
and the join is on key and bin, so a person is spread over many tasks and few pairs are tried in vain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: a bin has 2 ** BIN_BITS days; an interval of more than MOST_BINS of them stands in bins of bins
BIN_BITS, MOST_BINS, COARSE_BITS = 6, 64, 6


def _bin(day: Column) -> Column:
    return F.shiftright(F.unix_date(day), BIN_BITS)


def _fine(number: Column) -> Column:
    return number * 2


def _coarse(number: Column) -> Column:
    return F.shiftright(number, COARSE_BITS) * 2 + 1


def join_days(
    records: DataFrame, day: str, spans: DataFrame, start: str, end: str, key: str = "person_id", closed: bool = True
) -> DataFrame:
    """Every record with every span of its key whose days hold the record's day, both ends included if
    ``closed``, else neither. ``key`` stands in both frames and once in the result; other columns must
    differ. A span without a day inside, or with an unknown end, holds nothing.

    A day stands in one fine bin, and in one coarse bin only if some span is long; a span stands in
    bins of one kind, so no pair comes twice.
    """
    first, last = F.col(start), F.col(end)
    low, high = _bin(first), _bin(last)
    long = high - low >= MOST_BINS
    some_long = spans.agg(F.coalesce(F.max(long), F.lit(False)).alias("long")).scalar()
    bins = F.when(long, F.transform(F.sequence(F.shiftright(low, COARSE_BITS), F.shiftright(high, COARSE_BITS)), lambda b: b * 2 + 1))
    placed = (
        spans.filter(first <= last if closed else first < last)
        .withColumnRenamed(key, "_key")
        .withColumn("_place", F.explode(bins.otherwise(F.transform(F.sequence(low, high), _fine))))
    )
    own = _bin(F.col(day))
    dated = records.filter(F.col(day).isNotNull()).withColumn(
        "_bin", F.explode(F.when(some_long, F.array(_fine(own), _coarse(own))).otherwise(F.array(_fine(own))))
    )
    holds = (F.col(day) >= first) & (F.col(day) <= last) if closed else (F.col(day) > first) & (F.col(day) < last)
    return dated.join(placed, (F.col(key) == F.col("_key")) & (F.col("_bin") == F.col("_place")) & holds).drop("_key", "_place", "_bin")
