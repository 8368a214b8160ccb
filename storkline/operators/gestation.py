"""Gestation branch: runs of rising gestational weeks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storkline.config import Params
from storkline.functions.rows import first_row, whole
from storkline.operators.cohort import TRAITS


def gestation_visits(coded: DataFrame, ages: DataFrame) -> DataFrame:
    """Rows with a week from the code list, and rows of the age concepts with their value as week."""
    marked = coded.join(ages.select("concept_id", F.lit(True).alias("_age")), "concept_id", "left")
    from_value = F.when(F.col("_age"), whole(F.col("value_as_number")))
    weeks = F.array_compact(F.array(F.col("gest_value").cast("int"), from_value))
    return (
        marked.withColumn("week", F.explode(weeks))
        .withColumn("gest_value", F.col("week"))
        .select(*coded.columns)
    )


def gestation_days(visits: DataFrame, p: Params) -> DataFrame:
    """One row per person and day with the largest plausible week; days without one keep null."""
    plausible = (F.col("gest_value") > 0) & (F.col("gest_value") <= p.max_week)
    rows = visits.filter(F.col("visit_date").isNotNull()).withColumn(
        "gest_week", F.when(plausible, F.col("gest_value"))
    )
    keep = [c for c in ["person_id", "visit_date", "gest_week", "data_partner_id", *TRAITS] if c in rows.columns]
    return first_row(
        rows.select(*keep), ["person_id", "visit_date"],
        [F.col("gest_week").desc_nulls_last(), "data_partner_id"],
    )


def gestation_episodes(days: DataFrame, p: Params) -> DataFrame:
    """Number the runs: a new one starts where the week falls or stays after a long gap, or
    rises by less than the days passed allow for."""
    w = Window.partitionBy("person_id").orderBy("visit_date")
    falls = (F.col("week_diff") <= 0) & (F.col("date_diff") >= p.min_gap_days)
    lags = (F.col("week_diff") > 0) & (F.col("date_diff") >= F.col("week_diff") * 7 + p.buffer_days)
    starts = F.col("week_diff").isNull() | falls | lags
    return (
        days.filter(F.col("gest_week").isNotNull())
        .withColumns({
            "week_diff": F.col("gest_week") - F.lag("gest_week").over(w),
            "date_diff": F.date_diff("visit_date", F.lag("visit_date").over(w)),
        })
        .withColumn("episode", F.sum(starts.cast("int")).over(w))
    )


def gestation_bounds(episodes: DataFrame) -> DataFrame:
    """Per run: first and last day with their weeks, smallest and largest week with their days."""
    week, day = F.col("gest_week"), F.col("visit_date")
    traits = [c for c in TRAITS if c in episodes.columns]
    return (
        episodes.groupBy("person_id", "episode", *traits)
        .agg(
            F.min_by("data_partner_id", day).alias("data_partner_id"),
            F.min(day).alias("first_gest_date"),
            F.min_by(week, day).alias("first_gest_week"),
            F.max(day).alias("end_gest_date"),
            F.max_by(week, day).alias("end_gest_week"),
            F.min(week).alias("min_gest_week"),
            F.min(F.struct(week, day)).alias("_low"),
            F.max(F.struct(-week, day)).alias("_low_last"),
            F.max(week).alias("max_gest_week"),
            F.min(F.struct((-week).alias("w"), day)).alias("_high"),
        )
        .withColumns({
            "min_gest_date": F.col("_low.visit_date"),
            "min_gest_date_2": F.col("_low_last.visit_date"),
            "max_gest_date": F.col("_high.visit_date"),
        })
        .drop("_low", "_low_last", "_high")
    )
