"""Inferred start dates: exact weeks and month ranges weighed against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storkline.config import Params
from storkline.functions.intervals import join_days
from storkline.functions.labels import precision_label
from storkline.functions.rows import first_row
from storkline.functions.spread import at_rank, by_value, intersect, overlap_counts, quantile, total
from storkline.operators.pps import month_lookup

WEEK_NAME = "gestation period,"  # fixed value, matched without case
WEEK_TYPE, RANGE_TYPE = "GW", "GR3m"
EPISODE = ["person_id", "episode_number"]
# sorts unknown weeks after all others
NO_WEEK = 2147483647


def timing_records(event: DataFrame, timing: DataFrame, months: DataFrame) -> DataFrame:
    """Records, other than drugs, named as a gestation period or listed as timing evidence."""
    listed = (
        timing.select("concept_id")
        .unionByName(months.select(F.col("domain_concept_id").alias("concept_id")))
        .distinct()
        .withColumn("_listed", F.lit(True))
    )
    return (
        event.filter(F.col("domain") != "drug")
        .join(listed, "concept_id", "left")
        .filter(F.col("_listed") | F.lower("concept_name").contains(WEEK_NAME))
        .drop("_listed")
    )


def in_episodes(records: DataFrame, episodes: DataFrame) -> DataFrame:
    """Records within the recorded dates of the person's episodes, both ends included."""
    spans = episodes.select(*EPISODE, "recorded_episode_start", "recorded_episode_end")
    return join_days(records, "event_date", spans, "recorded_episode_start", "recorded_episode_end")


def week_value(records: DataFrame, p: Params) -> DataFrame:
    """The record's value as whole weeks: its name, text value or number, by domain."""
    # Text around the number.
    markers = [] if p.keep_value_markers else [r"\|text_result_val:", r"\|mapped_text_result_val:"]
    around = "|".join([*markers, "Gestation period, ", "gestation period, ", " weeks"])
    raw = (
        F.when(F.col("domain").isin("condition", "procedure"), F.col("concept_name"))
        .when(F.col("domain") == "observation", F.col("value_as_string"))
        .otherwise(F.col("value_as_number").cast("string"))
    )
    number = F.regexp_replace(raw, around, "").try_cast("double")
    return records.withColumn("domain_value", number.try_cast("int"))


def week_start(records: DataFrame, ages: DataFrame, p: Params) -> DataFrame:
    """Start date counted back from a week value, for gestation periods and age concepts."""
    is_week = F.lower("concept_name").contains(WEEK_NAME)
    is_age = F.col("is_age") & (F.col("domain_value") < p.max_week_value)
    return (
        records.join(ages.select("concept_id", F.lit(True).alias("_age")), "concept_id", "left")
        .withColumn("is_age", F.coalesce("_age", F.lit(False)))
        .drop("_age")
        .withColumn(
            "extrapolated_preg_start",
            F.when(F.coalesce(is_week, F.lit(False)) | F.coalesce(is_age, F.lit(False)),
                   F.date_sub("event_date", F.col("domain_value") * 7)),
        )
    )


def with_months(records: DataFrame, months: DataFrame) -> DataFrame:
    return records.join(month_lookup(months), "concept_id", "left")


def timing_concepts(
    event: DataFrame, episodes: DataFrame, timing: DataFrame, ages: DataFrame, months: DataFrame, p: Params
) -> DataFrame:
    """All evidence records inside episodes, with value, start date and month range."""
    records = in_episodes(timing_records(event, timing, months), episodes)
    return with_months(week_start(week_value(records, p), ages, p), months)


def classify(timed: DataFrame) -> DataFrame:
    """Exact week or month range; week records without a usable value are dropped."""
    is_week = F.coalesce(F.col("concept_name").contains("Gestation period"), F.lit(False)) | F.col("is_age")
    usable = F.col("domain_value").isNotNull() & F.col("extrapolated_preg_start").isNotNull()
    kind = F.when(is_week, F.when(usable, WEEK_TYPE)).when(F.col("min_month").isNotNull(), RANGE_TYPE)
    return timed.withColumn("gt_type", kind).filter(F.col("gt_type").isNotNull())


def range_bounds(classified: DataFrame, p: Params) -> DataFrame:
    """Latest and earliest start a month range allows."""
    def back(month: str) -> Column:
        days = F.round(F.col(month) * p.days_per_month).cast("int")
        return F.when(F.col("gt_type") == RANGE_TYPE, F.date_sub("event_date", days))

    return classified.withColumn("min_pregnancy_start", back("min_month")).withColumn(
        "max_pregnancy_start", back("max_month")
    )


def dedupe_evidence(bounded: DataFrame, *scope: str) -> DataFrame:
    """Per person, day and kind one week record, and one range record per concept name: the
    one with the highest value. Does not depend on the episode, so it can run before the
    join to episodes and bounds what that join gathers per person."""
    rollup = F.when(F.col("domain_value").isNotNull(), "Gestation Week").otherwise(F.col("concept_name"))
    keep = ["person_id", *scope, "event_date", "concept_id", "concept_name", "rollup_name", "gt_type",
            "domain_value", "extrapolated_preg_start", "min_pregnancy_start", "max_pregnancy_start"]
    return first_row(
        bounded.withColumn("rollup_name", rollup).select(*keep),
        ["person_id", *scope, "rollup_name", "event_date", "gt_type"],
        [F.col("domain_value").desc_nulls_last(), "concept_id", "concept_name", "extrapolated_preg_start"],
    )


def evidence_lists(evidence: DataFrame) -> DataFrame:
    """Per episode the exact starts and the start ranges, each held once with its count.

    The days of an episode bound both lists. Exact starts come in order of falling week.
    """
    two_sided = F.col("extrapolated_preg_start").isNull() & F.col("min_pregnancy_start").isNotNull() & F.col(
        "max_pregnancy_start"
    ).isNotNull()
    one = F.coalesce("extrapolated_preg_start", "min_pregnancy_start", "max_pregnancy_start")
    rank = F.struct(
        F.coalesce(-F.col("domain_value"), F.lit(NO_WEEK)).alias("week"), "event_date", "concept_id"
    )
    counted = (
        evidence.withColumn("start", F.when(two_sided, F.least("min_pregnancy_start", "max_pregnancy_start")).otherwise(one))
        .withColumn("end", F.when(two_sided, F.greatest("min_pregnancy_start", "max_pregnancy_start")))
        .groupBy(*EPISODE, "start", "end")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(rank).alias("rank"),
            F.max((F.col("gt_type") == WEEK_TYPE).cast("int")).alias("gw"),
            F.max((F.col("gt_type") == RANGE_TYPE).cast("int")).alias("gr3m"),
        )
    )
    week = F.when(F.col("end").isNull() & F.col("start").isNotNull(), F.struct("rank", "start", "n"))
    span = F.when(F.col("end").isNotNull(), F.struct("start", "end", "n"))
    return counted.groupBy(*EPISODE).agg(
        F.sort_array(F.collect_list(week)).alias("weeks"),
        F.sort_array(F.collect_list(span)).alias("ranges"),
        F.max("gw").alias("gw_flag"),
        F.max("gr3m").alias("gr3m_flag"),
    )


def range_outliers(lists: DataFrame) -> DataFrame:
    """Ranges by falling number of overlaps; those with unusually few are left out of ``kept``."""
    counted = lists.withColumn("_counted", overlap_counts(F.col("ranges")))
    spread = by_value(F.col("_counted"), "overlaps")
    df = counted.withColumn("_spread", spread).withColumn("_ordered", F.sort_array("_counted"))
    q1, q3 = quantile(F.col("_spread"), 0.25), quantile(F.col("_spread"), 0.75)
    df = df.withColumn("overlap_threshold", F.abs(q1 - (q3 - q1) * 1.5))
    limit = F.col("overlap_threshold")
    kept = F.filter(
        "_ordered", lambda r: F.when(limit == 0, r["overlaps"] != 0).otherwise(r["overlaps"] >= limit)
    )
    return df.withColumn("kept", kept).drop("_counted", "_spread")


def range_intersection(with_outliers: DataFrame) -> DataFrame:
    """Span and core of the kept ranges; of none kept, the range with most overlaps."""
    basis = F.when(F.size("kept") > 0, F.col("kept")).otherwise(F.slice("_ordered", 1, 1))
    return (
        with_outliers.withColumn("_basis", basis)
        .withColumn("_fold", intersect(F.col("_basis")))
        .select("*", "_fold.*")
        .drop("_ordered", "_basis", "_fold")
    )


def widen_core(intersected: DataFrame, p: Params) -> DataFrame:
    """Middle of the core, and the core widened around it where it is short."""
    days = F.date_diff("core_end", "core_start")
    short = days < p.min_core_days
    return (
        intersected.withColumn("core_midpoint", F.date_add("core_start", F.floor(days / 2).cast("int")))
        .withColumn("range_days", F.date_diff("span_end", "span_start"))
        .withColumn("_short", short)
        .withColumn("core_start", F.when(F.col("_short"), F.date_sub("core_midpoint", p.core_half_width)).otherwise(F.col("core_start")))
        .withColumn("core_end", F.when(F.col("_short"), F.date_add("core_midpoint", p.core_half_width)).otherwise(F.col("core_end")))
        .drop("_short")
    )


def week_outliers(df: DataFrame, weeks: str, result: str) -> DataFrame:
    """Drop exact starts unusually far from, or near to, the upper median; keeps the order."""
    df = df.withColumn("_starts", by_value(F.col(weeks), "start"))
    df = df.withColumn("_median", at_rank(F.col("_starts"), F.floor(total(F.col("_starts")) / 2), "date"))
    away = F.transform(
        weeks, lambda w: F.struct(F.abs(F.date_diff(w["start"], F.col("_median"))).alias("away"), w["n"].alias("n"))
    )
    df = df.withColumn("_away", by_value(away, "away"))
    df = df.withColumn("_q1", quantile(F.col("_away"), 0.25)).withColumn("_q3", quantile(F.col("_away"), 0.75))
    reach = (F.col("_q3") - F.col("_q1")) * 1.5
    df = df.withColumn("_low", F.col("_q1") - reach).withColumn("_high", F.col("_q3") + reach)
    return df.withColumn(
        result,
        F.filter(weeks, lambda w: F.abs(F.date_diff(w["start"], F.col("_median"))).between(F.col("_low"), F.col("_high"))),
    ).drop("_starts", "_median", "_away", "_q1", "_q3", "_low", "_high")


def choose_start(widened: DataFrame, p: Params) -> DataFrame:
    """The start and its precision in days: weeks inside the core if they are the majority,
    else all weeks, else the core's middle."""
    has_core = F.col("core_start").isNotNull()
    inside = F.filter("weeks", lambda w: w["start"].between(F.col("core_start"), F.col("core_end")))
    df = (
        widened.withColumn("_has_week", F.size("weeks") > 0)
        .withColumn("_inside", inside)  # empty without a core
        .withColumn("intervals_count", (F.col("_has_week") & has_core).cast("int"))
    )
    share = F.try_divide(total(F.col("_inside")), total(F.col("weeks"))) * 100
    df = df.withColumn(
        "majority_overlap_count", F.coalesce(F.col("_has_week") & (share > p.majority_percent), F.lit(False)).cast("int")
    )
    majority = F.col("majority_overlap_count") == 1
    df = df.withColumn("_used", F.when(majority, F.col("_inside")).otherwise(F.col("weeks")))
    df = week_outliers(df, "_used", "_good")
    starts = F.transform("_good", lambda w: w["start"])
    lone = ~majority & (total(F.col("_good")) == 1)
    spread = F.when(lone, -1).otherwise(F.date_diff(F.array_max(starts), F.array_min(starts)))
    return (
        df.withColumn(
            "inferred_episode_start",
            F.when(F.col("_has_week"), F.get(starts, F.lit(0))).otherwise(F.col("core_midpoint")),
        )
        .withColumn("precision_days", F.when(F.col("_has_week"), spread).otherwise(F.col("range_days")))
        .drop("_has_week", "_inside", "_used", "_good")
    )


def infer_start(lists: DataFrame, p: Params) -> DataFrame:
    """Start, precision and its label from an episode's evidence."""
    widened = widen_core(range_intersection(range_outliers(lists)), p)
    return choose_start(widened, p).withColumn("precision_category", precision_label(F.col("precision_days")))


def evidence(
    event: DataFrame, episodes: DataFrame, timing: DataFrame, ages: DataFrame, months: DataFrame, p: Params
) -> DataFrame:
    """Evidence rows of each episode, reduced per person and day before they meet the episodes."""
    records = timing_records(event, timing, months)
    timed = with_months(week_start(week_value(records, p), ages, p), months)
    return in_episodes(dedupe_evidence(range_bounds(classify(timed), p)), episodes)


def timing_info(
    event: DataFrame, episodes: DataFrame, timing: DataFrame, ages: DataFrame, months: DataFrame, p: Params
) -> DataFrame:
    """One row per episode with evidence: start, precision and evidence flags."""
    rows = evidence(event, episodes, timing, ages, months, p)
    return infer_start(evidence_lists(rows), p).select(
        *EPISODE, "weeks", "ranges", "gw_flag", "gr3m_flag", "inferred_episode_start", "precision_days",
        "precision_category", "intervals_count", "majority_overlap_count",
    )


def overlap_stats(info: DataFrame) -> DataFrame:
    """How many episodes have both kinds of evidence, and how often the weeks agree with the core."""
    return info.agg(
        F.sum("intervals_count").alias("intervals_total"),
        F.sum("majority_overlap_count").alias("majority_total"),
    ).withColumn("majority_percent", F.try_divide(F.col("majority_total"), F.col("intervals_total")) * 100)
