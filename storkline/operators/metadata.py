"""The final table: outcome agreement, dates, precision, term fit and demographics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storkline.config import NO_OUTCOME, Params
from storkline.functions.labels import ethnicity_group, precision_label, race_ethnicity, race_group
from storkline.functions.rows import birth_date, flag
from storkline.operators.outcomes import term_rules


def with_timing(detail: DataFrame, info: DataFrame) -> DataFrame:
    """Episodes with their timing evidence; missing evidence flags become 0."""
    wanted = info.select(
        "person_id", "episode_number", "gw_flag", "gr3m_flag", "inferred_episode_start", "precision_days",
        "precision_category",
    )
    return (
        detail.join(wanted, ["person_id", "episode_number"], "left")
        .withColumn("gw_flag", F.coalesce("gw_flag", F.lit(0)))
        .withColumn("gr3m_flag", F.coalesce("gr3m_flag", F.lit(0)))
    )


def outcome_match(df: DataFrame, p: Params) -> DataFrame:
    """1 where both branches give the same outcome at nearly the same date."""
    hip, pps = F.col("hip_outcome_category"), F.col("pps_outcome_category")
    near = F.abs(F.date_diff("hip_end_date", "pps_end_date")) <= p.match_window_days
    return df.withColumn("outcome_match", flag((hip == pps) & ((hip == NO_OUTCOME) | near)))


def _later_pps(p: Params) -> Column:
    """Both branches give an outcome, and the timing branch's comes clearly later."""
    return (
        (F.col("hip_outcome_category") != NO_OUTCOME)
        & (F.col("pps_outcome_category") != NO_OUTCOME)
        & (F.col("hip_end_date") <= F.date_sub("pps_end_date", p.later_outcome_days))
    )


def _take(hip: str, pps: str, p: Params) -> Column:
    """The outcome branch's value, unless only the timing branch has an outcome or its is later."""
    use_pps = (F.col("outcome_match") == 0) & F.col("pps_outcome_category").isNotNull() & (
        F.col("hip_outcome_category").isNull() | _later_pps(p)
    )
    return F.when(use_pps, F.col(pps)).otherwise(F.col(hip))


def final_outcome(df: DataFrame, p: Params) -> DataFrame:
    return df.withColumn("final_outcome_category", _take("hip_outcome_category", "pps_outcome_category", p))


def episode_end(df: DataFrame, p: Params) -> DataFrame:
    return df.withColumn("inferred_episode_end", _take("hip_end_date", "pps_end_date", p))


def fill_start(df: DataFrame, terms: DataFrame) -> DataFrame:
    """Where no evidence gives a start, count the longest term back from the end."""
    rules = term_rules(terms).withColumnRenamed("category", "final_outcome_category").drop("retry")
    df = df.join(F.broadcast(rules), "final_outcome_category", "left")
    days = F.coalesce(F.col("precision_days"), F.col("max_term") - F.col("min_term"))
    return (
        df.withColumn(
            "inferred_episode_start",
            F.coalesce("inferred_episode_start", F.date_sub("inferred_episode_end", F.col("max_term"))),
        )
        .withColumn("precision_days", days)
        .withColumn("precision_category", F.coalesce("precision_category", precision_label(F.col("precision_days"))))
    )


def term_flag(df: DataFrame, p: Params) -> DataFrame:
    """Gestational age at the end, and whether it fits the outcome's term."""
    days = F.col("gestational_age_days_calculated")
    in_term = days.between(F.col("min_term"), F.col("max_term"))
    open_term = (F.col("final_outcome_category") == NO_OUTCOME) & (days <= p.open_term_days)
    return df.withColumn(
        "gestational_age_days_calculated", F.date_diff("inferred_episode_end", "inferred_episode_start")
    ).withColumn("term_duration_flag", F.when(in_term, 1).otherwise(flag(open_term)))


def concordance(df: DataFrame) -> DataFrame:
    """2 for a matched outcome that fits its term, 1 for an unmatched one that does, else 0."""
    fits = F.col("term_duration_flag") == 1
    return df.withColumn(
        "outcome_concordance_score", F.when(fits, F.col("outcome_match") + 1).otherwise(0)
    )


def age_at_start(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("date_of_birth", birth_date(F.lit(1)))
        .withColumn("birth_date_diff", F.date_diff("inferred_episode_start", "date_of_birth"))
        .withColumn("age_at_inferred_start", F.col("birth_date_diff") / 365)
    )


def race_and_ethnicity(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("race", race_group(F.col("race_concept_name")))
        .withColumn("ethnicity", ethnicity_group(F.col("ethnicity_concept_name"), F.col("race_concept_name")))
        .withColumn("race_ethnicity", race_ethnicity(F.col("race"), F.col("ethnicity")))
    )


def preterm(df: DataFrame, p: Params) -> DataFrame:
    return df.withColumn(
        "preterm_status_from_calculation", flag(F.col("gestational_age_days_calculated") < p.preterm_days)
    )


def period_summary(final: DataFrame) -> DataFrame:
    """The period the recorded and inferred episodes span."""
    return final.agg(
        F.min("recorded_episode_start").alias("min_episode_date"),
        F.max("recorded_episode_end").alias("max_episode_date"),
        F.min("inferred_episode_start").alias("min_pregnancy_date"),
        F.max("inferred_episode_end").alias("max_pregnancy_date"),
    )


def with_metadata(detail: DataFrame, info: DataFrame, terms: DataFrame, p: Params) -> DataFrame:
    """The final table from the merged episodes and their timing evidence."""
    df = outcome_match(with_timing(detail, info), p)
    df = fill_start(episode_end(final_outcome(df, p), p), terms)
    df = concordance(term_flag(df, p)).drop("min_term", "max_term")
    return preterm(race_and_ethnicity(age_at_start(df)), p)
