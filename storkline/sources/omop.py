"""Input tables: OMOP domain tables as one event table, and the code lists."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storkline.config import FixedConcepts


@dataclass(frozen=True)
class Tables:
    """Clinical and vocabulary tables."""

    person: DataFrame
    event: DataFrame
    visit: DataFrame
    concept: DataFrame | None = None
    concept_relationship: DataFrame | None = None


@dataclass(frozen=True)
class Lists:
    """Code lists and rule tables. None is broadcast by hint: Spark does so below its size limit."""

    initial: DataFrame  # concept_id, category
    outcomes: DataFrame  # concept_id, concept_name, category, gest_value
    months: DataFrame  # domain_concept_id, domain_concept_name, min_month, max_month
    limits: DataFrame  # first_preg_category, outcome_preg_category, min_days
    terms: DataFrame  # category, min_term, max_term, retry
    ages: DataFrame = field(kw_only=True)  # concept_id of gestational-age values
    timing: DataFrame = field(kw_only=True)  # concept_id of evidence for start dates
    denied: DataFrame = field(kw_only=True)  # concept_id never kept as timing-specific


# domain, table, concept id, concept name, date, record id
DOMAINS = (
    ("condition", "condition_occurrence", "condition_concept_id", "condition_concept_name",
     "condition_start_date", "condition_occurrence_id"),
    ("procedure", "procedure_occurrence", "procedure_concept_id", "procedure_concept_name",
     "procedure_date", "procedure_occurrence_id"),
    ("observation", "observation", "observation_concept_id", "observation_concept_name",
     "observation_date", "observation_id"),
    ("measurement", "measurement", "measurement_concept_id", "measurement_concept_name",
     "measurement_date", "measurement_id"),
    ("drug", "drug_exposure", "drug_concept_id", "drug_concept_name",
     "drug_exposure_start_date", "drug_exposure_id"),
)


def _column(df: DataFrame, name: str, kind: str) -> Column:
    value = F.col(name) if name in df.columns else F.lit(None)
    return value.cast(kind)


def to_events(domain: str, df: DataFrame, concept: str, name: str, when: str, record: str) -> DataFrame:
    """One domain table in the shape shared by all."""
    return df.select(
        F.col("person_id").cast("bigint"),
        F.lit(domain).alias("domain"),
        F.col(concept).cast("bigint").alias("concept_id"),
        _column(df, name, "string").alias("concept_name"),
        F.col(when).cast("date").alias("event_date"),
        _column(df, "data_partner_id", "int").alias("data_partner_id"),
        _column(df, "value_as_number", "double").alias("value_as_number"),
        _column(df, "value_as_string", "string").alias("value_as_string"),
        _column(df, record, "bigint").alias("record_id"),
    )


def union_events(domains: dict[str, DataFrame]) -> DataFrame:
    """All given domain tables as one event table; a missing domain is left out."""
    parts = [
        to_events(domain, domains[table], concept, name, when, record)
        for domain, table, concept, name, when, record in DOMAINS
        if table in domains
    ]
    return reduce(DataFrame.unionByName, parts)


def read_tables(spark: SparkSession, folder: str, fmt: str = "parquet") -> Tables:
    """Read the OMOP tables below one folder, ``folder/<table>``, in any Spark file format."""
    return _tables(lambda name: spark.read.format(fmt).load(f"{folder}/{name}"))


def catalog_tables(spark: SparkSession, database: str) -> Tables:
    """The OMOP tables of a database in the catalog, with whatever format and layout they have there."""
    return _tables(lambda name: spark.table(f"{database}.{name}"))


def _tables(read: Callable[[str], DataFrame]) -> Tables:
    return Tables(
        person=read("person"),
        event=union_events({table: read(table) for _, table, *_ in DOMAINS}),
        visit=read("visit_occurrence"),
        concept=read("concept"),
        concept_relationship=read("concept_relationship"),
    )


LIST_SCHEMAS = {
    "initial": "concept_id BIGINT, category STRING",
    "outcomes": "concept_id BIGINT, concept_name STRING, category STRING, gest_value INT",
    "months": "domain_concept_id BIGINT, domain_concept_name STRING, min_month DOUBLE, max_month DOUBLE",
    "limits": "first_preg_category STRING, outcome_preg_category STRING, min_days INT",
    "terms": "category STRING, min_term INT, max_term INT, retry INT",
}


def id_list(spark: SparkSession, ids: Iterable[int]) -> DataFrame:
    schema = T.StructType([T.StructField("concept_id", T.LongType(), False)])
    return spark.createDataFrame([(int(i),) for i in ids], schema)


def read_list(spark: SparkSession, name: str, path: str) -> DataFrame:
    """One code list from CSV with a header, or from Parquet; columns are taken by name."""
    schema = T.StructType.fromDDL(LIST_SCHEMAS[name])
    if path.endswith((".csv", ".csv.gz")):
        raw = spark.read.option("header", True).csv(path)
    else:
        raw = spark.read.parquet(path)
    return raw.select(*[F.col(f.name).cast(f.dataType) for f in schema])


def read_lists(
    spark: SparkSession, paths: dict[str, str], fixed: FixedConcepts | None = None
) -> Lists:
    """Code lists by name (see ``LIST_SCHEMAS``), with the fixed concept ids as further lists."""
    fixed = fixed or FixedConcepts()
    return Lists(
        **{name: read_list(spark, name, paths[name]) for name in LIST_SCHEMAS},
        ages=id_list(spark, fixed.gestational_age),
        timing=id_list(spark, fixed.timing),
        denied=id_list(spark, fixed.denied),
    )
