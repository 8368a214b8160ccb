"""Row-level helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key. Spark limits each group before the shuffle, so a hot key
    sends at most one row per map task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is unknown."""
    return F.when(condition, 1).otherwise(0)


def birth_date(day: Column) -> Column:
    """Birth date from year, month and the given day; null where they are no date."""
    parts = F.concat_ws("-", F.col("year_of_birth"), F.col("month_of_birth"), day)
    return parts.try_cast("date")


def whole(value: Column) -> Column:
    """A number as int, truncated; out-of-range values become the largest int."""
    return F.when(value.isNotNull(), F.coalesce(value.try_cast("int"), F.lit(2147483647)))
