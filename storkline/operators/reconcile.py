"""Gestation runs and outcomes joined into episodes, cleaned and freed of overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storkline.config import NO_OUTCOME, Params
from storkline.functions.rows import flag
from storkline.operators.cohort import TRAITS

OUTCOME_FIELDS = ["concept_id", "concept_name", "min_term", "max_term", "retry", "min_start_date", "max_start_date"]
GESTATION_FIELDS = ["first_gest_date", "first_gest_week", "end_gest_date", "end_gest_week", "min_gest_week",
                    "min_gest_date", "min_gest_date_2", "max_gest_week", "max_gest_date"]
# per-person order of episodes; the later columns only settle equal dates
EPISODE_ORDER = ["visit_date", "category", "max_gest_date", "outcome_date"]


def _per_person(*keys: str) -> Window:
    return Window.partitionBy("person_id", *keys)


def _numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("episode", F.row_number().over(_per_person().orderBy(*EPISODE_ORDER)))


def _overlaps(p: Params) -> Column:
    """A gestation run and an outcome belong together."""
    buffer = p.buffer_days
    g_start, g_end = F.col("g.max_gest_start_date"), F.col("g.max_gest_date")
    o_start, o_end = F.col("o.max_start_date"), F.col("o.visit_date")
    ends_near = g_end <= F.date_add(o_end, buffer)
    inside = (g_start >= F.date_sub(o_start, buffer)) & ends_near
    over_end = (
        (g_start >= F.date_sub(o_start, buffer)) & (g_start <= o_end) & (g_end >= F.date_add(o_end, buffer))
    )
    over_start = (g_start <= F.date_sub(o_start, buffer)) & ends_near & (g_end >= o_start)
    around = (g_start <= o_start) & (g_end >= o_end)
    return inside | over_end | over_start | around


def attach_gestation(outcomes: DataFrame, gestation: DataFrame, p: Params) -> DataFrame:
    """Every overlapping pair of outcome and run, and each side's rows without a partner.

    One full outer join: the spacing rules bound both sides per person. ``outcome_date``
    identifies the outcome, ``max_gest_date`` the run; each is null where that side is missing.
    """
    g = gestation.withColumns({
        "max_gest_start_date": F.date_sub("max_gest_date", F.col("max_gest_week") * 7),
        "min_gest_start_date": F.date_sub("min_gest_date", F.col("min_gest_week") * 7),
    })
    pairs = outcomes.alias("o").join(
        g.alias("g"), (F.col("o.person_id") == F.col("g.person_id")) & _overlaps(p), "full_outer"
    )

    def either(name: str) -> Column:
        return F.coalesce(F.col(f"o.{name}"), F.col(f"g.{name}")).alias(name)

    joined = pairs.select(
        either("person_id"),
        F.coalesce(F.col("o.category"), F.lit(NO_OUTCOME)).alias("category"),
        F.coalesce(F.col("o.visit_date"), F.col("g.max_gest_date")).alias("visit_date"),
        F.col("o.visit_date").alias("outcome_date"),
        *[F.col(f"o.{c}").alias(c) for c in OUTCOME_FIELDS],
        *[F.col(f"g.{c}").alias(c) for c in GESTATION_FIELDS],
        F.col("g.max_gest_start_date").alias("max_gest_start_date"),
        F.date_diff("g.max_gest_start_date", "g.min_gest_start_date").alias("gest_start_date_diff"),
        F.date_diff("o.visit_date", "g.max_gest_date").alias("days_diff"),
        either("data_partner_id"),
        *[either(c) for c in TRAITS],
    )
    # one shuffle for all steps per person that follow; a full outer join keeps none
    return _numbered(joined.repartition("person_id"))


def _nearest(df: DataFrame, key: str) -> DataFrame:
    """Of the rows sharing a key keep those with the smallest distance; ties and null keys stay."""
    best = F.min(F.abs("days_diff")).over(_per_person(key))
    return (
        df.withColumn("_best", best)
        .filter(F.col(key).isNull() | F.col("days_diff").isNull() | (F.abs("days_diff") == F.col("_best")))
        .drop("_best")
    )


def _without_outcome(df: DataFrame, when: Column) -> DataFrame:
    """Turn the rows where the condition holds into episodes without an outcome."""
    cleared = [*OUTCOME_FIELDS, "days_diff", "outcome_date"]
    df = df.withColumn("_drop", F.coalesce(when, F.lit(False)))
    return df.select(
        *[
            F.when(~F.col("_drop"), F.col(c)).alias(c) if c in cleared
            else F.when(F.col("_drop"), F.col("max_gest_date")).otherwise(F.col(c)).alias(c) if c == "visit_date"
            else F.when(F.col("_drop"), F.lit(NO_OUTCOME)).otherwise(F.col(c)).alias(c) if c == "category"
            else F.when(F.col("_drop"), F.col("category")).otherwise(F.col(c)).alias(c) if c == "removed_category"
            else F.when(F.col("_drop"), 1).otherwise(F.col(c)).alias(c) if c == "removed_outcome"
            else F.col(c)
            for c in df.columns if c != "_drop"
        ]
    )


def clean_episodes(episodes: DataFrame, p: Params) -> DataFrame:
    """One outcome per run and one run per outcome by distance; outcomes that do not fit the
    run's gestational age are removed."""
    df = _nearest(_nearest(episodes, "max_gest_date"), "outcome_date")
    at_outcome = F.date_diff("visit_date", "max_gest_start_date")
    both = F.col("max_gest_date").isNotNull() & F.col("outcome_date").isNotNull()
    over_max = ~F.coalesce(at_outcome <= F.col("max_term"), F.lit(False))
    before_run = F.col("days_diff") < -p.buffer_days
    df = df.withColumns({"removed_category": F.lit(None).cast("string"), "removed_outcome": F.lit(0)})
    df = _without_outcome(df, both & (over_max | before_run))
    df = df.withColumns({
        "gest_at_outcome": at_outcome,
        "min_gest_date_diff": F.date_diff("min_gest_date_2", "min_gest_date"),
        "date_diff_max_end": F.date_diff("max_gest_date", "end_gest_date"),
    })
    return _numbered(df)


def remove_overlaps(episodes: DataFrame) -> DataFrame:
    """Drop an episode without outcome that the next one overlaps; otherwise start the later
    episode after the earlier one's retry period. One pass, on the order before any drop."""
    w = _per_person().orderBy(*EPISODE_ORDER)
    start = F.coalesce("max_gest_start_date", "max_start_date")
    no_outcome = F.col("category") == NO_OUTCOME
    df = (
        episodes.withColumns({"prev_date": F.lag("visit_date").over(w), "prev_retry": F.lag("retry").over(w)})
        .withColumn("has_overlap", flag(F.date_diff(start, "prev_date") < 0))
        .withColumn("_overlapped", no_outcome & (F.lead("has_overlap").over(w) == 1))
        .withColumn("_dropped", F.max("_overlapped").over(_per_person("max_gest_date")))
        .filter(~(no_outcome & F.coalesce("_dropped", F.lit(False))))
        .drop("_overlapped", "_dropped")
    )
    moved = (F.col("has_overlap") == 1) & F.col("prev_retry").isNotNull()
    df = (
        df.withColumn("estimated_start_date", F.when(moved, F.date_add("prev_date", F.col("prev_retry"))).otherwise(start))
        .withColumn("gest_at_outcome", F.date_diff("visit_date", "estimated_start_date"))
        .withColumns({
            "is_under_max": flag(F.col("gest_at_outcome") <= F.col("max_term")),
            "is_over_min": flag(F.col("gest_at_outcome") >= F.col("min_term")),
        })
    )
    df = _numbered(df)
    too_short = F.col("max_gest_week").isNotNull() & F.col("concept_name").isNotNull() & (F.col("is_over_min") == 0)
    return _without_outcome(df, too_short)


def episode_table(episodes: DataFrame) -> DataFrame:
    return episodes.select(
        "person_id", "category", "visit_date", "estimated_start_date", "episode", "data_partner_id", *TRAITS
    ).distinct()


def episode_lengths(episodes: DataFrame, gestation: DataFrame) -> DataFrame:
    """First gestation day inside each episode and the days from it to the end, at least 1.

    The next gestation day on or after the start is read off one pass over both row kinds in
    falling date order, so no pairs of episodes and days are built.
    """
    marks = gestation.select(
        "person_id", F.col("visit_date").alias("_at"), F.col("visit_date").alias("gest_date")
    ).filter(F.col("_at").isNotNull()).distinct()
    rows = episodes.withColumn("_at", F.col("estimated_start_date")).withColumn("_episode", F.lit(True))
    w = (
        Window.partitionBy("person_id")
        .orderBy(F.col("_at").desc_nulls_last(), F.col("_episode").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = (
        rows.unionByName(marks, allowMissingColumns=True)
        .withColumn("gest_date", F.last("gest_date", ignorenulls=True).over(w))
        .filter("_episode")
        .withColumn(
            "gest_date",
            F.when(F.col("_at").isNotNull() & (F.col("gest_date") <= F.col("visit_date")), F.col("gest_date")),
        )
        .drop("_at", "_episode")
    )
    days = F.date_diff("visit_date", "gest_date")
    return found.withColumn(
        "episode_length", F.when(days.isNull() | (days == 0), 1).otherwise(days)
    )
