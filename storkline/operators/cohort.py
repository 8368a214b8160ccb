"""Coded events of women of reproductive age."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storkline.config import Params

CODED = ["person_id", "concept_id", "concept_name", "data_partner_id", "visit_date", "category",
         "gest_value", "value_as_number"]
TRAITS = ["year_of_birth", "race_concept_name", "ethnicity_concept_name"]


def coded_events(event: DataFrame, codes: DataFrame, p: Params) -> DataFrame:
    """Events in the study window, other than drugs, that carry a listed code."""
    has_value = F.col("domain").isin("observation", "measurement")
    listed = codes.select("concept_id", "category", "gest_value")
    return (
        event.filter((F.col("event_date") > F.lit(p.study_start)) & (F.col("event_date") <= F.lit(p.study_end)))
        .filter(F.col("domain") != "drug")
        .withColumn("value_as_number", F.when(has_value, F.col("value_as_number")))
        .withColumnRenamed("event_date", "visit_date")
        .join(listed, "concept_id")
        .select(*CODED)
    )


def women(person: DataFrame, p: Params) -> DataFrame:
    """Women born in the study's range of years."""
    return (
        person.filter(F.col("gender_concept_name") == "FEMALE")
        .filter(F.col("year_of_birth").between(p.birth_year_min, p.birth_year_max))
        .select("person_id", *TRAITS)
        .distinct()
    )


def with_women(df: DataFrame, person: DataFrame, p: Params) -> DataFrame:
    """Keep rows of those women, with their traits. Reduce ``df`` per person first: here each
    person's rows are gathered, and the join and all per-person steps after it reuse that shuffle."""
    return df.repartition("person_id").join(women(person, p), "person_id")


def only_women(df: DataFrame, person: DataFrame, p: Params) -> DataFrame:
    """The rows of those women. A plain filter: large persons are left to Spark's skew handling."""
    return df.join(women(person, p).select("person_id"), "person_id", "left_semi")


def initial_cohort(event: DataFrame, codes: DataFrame, person: DataFrame, p: Params) -> DataFrame:
    """Distinct coded events of the cohort. Values do not bound a person's rows here, so the join
    is left to Spark's skew handling."""
    return coded_events(event, codes, p).distinct().join(women(person, p), "person_id")
