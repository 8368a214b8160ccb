"""Concepts that occur at a stable time of the pregnancy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storkline.config import NO_OUTCOME, Params
from storkline.functions.intervals import join_days
from storkline.operators.prevalence import match_key

CONCEPT = ["domain_concept_id", "domain_concept_name"]


def listed_records(event: DataFrame, specific: DataFrame, p: Params) -> DataFrame:
    """The records of the listed concepts, with the columns that name equal ones."""
    listed = specific.select(F.col("concept_id").alias("_key")).distinct()
    return event.withColumn("_key", match_key(p)).join(listed, "_key", "left_semi").select(
        "person_id", "domain", F.col("concept_id").alias("domain_concept_id"),
        F.col("concept_name").alias("domain_concept_name"), F.col("event_date").alias("domain_concept_start_date"),
    )


def counted(records: DataFrame) -> DataFrame:
    """Equal rows once, with their number."""
    return records.groupBy(*records.columns).agg(F.count(F.lit(1)).alias("n_records"))


def match_concepts(event: DataFrame, specific: DataFrame, p: Params) -> DataFrame:
    """Records of the listed concepts at any time, equal ones counted."""
    return counted(listed_records(event, specific, p))


def in_episodes(records: DataFrame, episodes: DataFrame) -> DataFrame:
    """Records strictly between start and end of the person's episodes."""
    spans = episodes.select(
        "person_id", "episode", F.col("estimated_start_date").alias("start_date_of_pregnancy"),
        F.col("visit_date").alias("end_date"), "category",
    )
    return join_days(records, "domain_concept_start_date", spans, "start_date_of_pregnancy", "end_date", closed=False)


def episode_concepts(event: DataFrame, specific: DataFrame, episodes: DataFrame, p: Params) -> DataFrame:
    """Records of the listed concepts inside episodes with a definite outcome, equal ones counted.

    Few records lie in an episode, and few of all records are equal, so they meet the episodes first: the
    events move once at most, by person and bin of time, and counting moves only what is found.
    """
    definite = episodes.filter(~F.col("category").isin(NO_OUTCOME, "DELIV"))
    return counted(in_episodes(listed_records(event, specific, p), definite))


def gestation_months(records: DataFrame, p: Params) -> DataFrame:
    """Months from the start, and for live births also from the full term before the end."""
    term_start = F.when(F.col("category") == "LB", F.add_months("end_date", -p.full_term_months))
    return (
        records.withColumn("days", F.date_diff("domain_concept_start_date", "start_date_of_pregnancy"))
        .withColumn("gestation_month", F.col("days") / 30)
        .withColumn("start_date_of_pregnancy_ft", term_start)
        .withColumn("days_ft", F.date_diff("domain_concept_start_date", "start_date_of_pregnancy_ft"))
        .withColumn("gestation_month_ft", F.col("days_ft") / 30)
    )


#: sums of days and of their squares, with multiplicity: whole numbers, so partials add up exactly in any order
MOMENTS = ["_n", "_s1", "_s2"]


def month_moments(days: str) -> list[Column]:
    """Number, sum and sum of squares of whole days with multiplicity, as MOMENTS."""
    times = F.when(F.col(days).isNotNull(), F.col("n_records")).cast("decimal(19,0)")
    day = F.col(days).cast("decimal(9,0)")
    return [F.sum(x).cast("decimal(38,0)").alias(m) for m, x in zip(MOMENTS, (times, day * times, day * day * times), strict=True)]


def add_moments() -> list[Column]:
    """The moments of groups put together."""
    return [F.sum(m).cast("decimal(38,0)").alias(m) for m in MOMENTS]


def from_moments(mean: str, stddev: str) -> list[Column]:
    """Mean and sample deviation in months. The difference that the variance rests on is taken in whole
    numbers, so nothing cancels however many records there are."""
    n, s1, s2 = (F.col(m) for m in MOMENTS)
    spread = (n * s2 - s1 * s1).cast("double")
    return [
        (F.try_divide(s1.cast("double"), n.cast("double")) / 30).alias(mean),
        F.when(n > 1, F.sqrt(F.try_divide(spread, n.cast("double") * (n - 1).cast("double"))) / 30).alias(stddev),
    ]


def stable_concepts(months: DataFrame, denied: DataFrame, p: Params) -> DataFrame:
    """Mean and spread of the month per concept and outcome, for concepts frequent enough, with
    little spread in every outcome and across outcomes, and on no deny list."""
    episodes = months.select("person_id", "episode", "category").distinct().groupBy("category").agg(
        F.count(F.lit(1)).alias("_episodes")
    )
    shares = (
        months.select("person_id", "episode", *CONCEPT, "category").distinct()
        .groupBy(*CONCEPT, "category").agg(F.count(F.lit(1)).alias("_with"))
        .join(episodes, "category")
        .select(*CONCEPT, "category", (F.col("_with") / F.col("_episodes") * 100).alias("percent_episodes"))
    )
    # one row per record, and for live births one more counted from full term
    views = F.array(
        F.struct(F.col("category").alias("view"), F.col("days").alias("view_days")),
        F.struct(F.lit("LB_FT").alias("view"), F.col("days_ft").alias("view_days")),
    )
    stats = (
        months.select(*CONCEPT, "category", "n_records", F.explode(views).alias("v"))
        .select(*CONCEPT, "category", "n_records", "v.view", "v.view_days")
        .filter((F.col("view") != "LB_FT") | F.col("view_days").isNotNull())
        .groupBy("view", "category", *CONCEPT)
        .agg(*month_moments("view_days"), F.sum("n_records").cast("int").alias("num_appearances"))
        .join(shares, [*CONCEPT, "category"])
        .select(*CONCEPT, F.col("view").alias("category"), "percent_episodes", *from_moments("mean_month", "stddev_of_month"),
                "num_appearances")
    )
    frequent = stats.filter(F.col("percent_episodes") > p.min_share)

    def too_wide(stddev: str, limit: float) -> Column:
        wide = F.col(stddev) > limit
        return F.coalesce(wide, F.lit(True)) if p.drop_single_sample else wide

    # the statistics hold a row per concept and view; both rules are settled on them in place
    by_id = Window.partitionBy("domain_concept_id")
    steady = (
        frequent.withColumn("_wide", F.max(F.coalesce(too_wide("stddev_of_month", p.max_stddev), F.lit(False))).over(by_id))
        .filter(~F.col("_wide"))
    )
    across = F.stddev_samp("mean_month").over(Window.partitionBy(*CONCEPT))
    kept = (
        steady.withColumn("_across", across)
        .withColumn("_shifts", F.max(F.coalesce(too_wide("_across", p.max_stddev_across), F.lit(False))).over(by_id))
        .filter(~F.col("_shifts"))
        .drop("_wide", "_across", "_shifts")
    )
    not_kept = denied.select(F.col("concept_id").alias("domain_concept_id")).distinct()
    return kept.join(not_kept, "domain_concept_id", "left_anti")


def concept_summary(stable: DataFrame, months: DataFrame) -> DataFrame:
    """Overall month and persons of each stable concept, for review."""
    kept = stable.select(*CONCEPT).distinct()
    # first per concept and person, then per concept: persons are counted without a set of them in one place
    persons = months.join(kept, CONCEPT).groupBy(*CONCEPT, "person_id").agg(*month_moments("days"))
    sums = persons.groupBy(*CONCEPT).agg(*add_moments(), F.count("person_id").alias("distinct_patients"))
    return sums.select(*CONCEPT, *from_moments("mean_gestation_month", "stddev_gestation_month"), "distinct_patients")
