"""How often concepts occur in persons with a code of interest against all others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storkline.config import Params
from storkline.functions.rows import birth_date
from storkline.session import cut


def match_key(p: Params) -> Column:
    """The id a row is matched on: the concept, or for drugs by choice the record."""
    if p.drug_by_record_id:
        return F.when(F.col("domain") == "drug", F.col("record_id")).otherwise(F.col("concept_id"))
    return F.col("concept_id")


def persons_with_code(event: DataFrame, codes: DataFrame, p: Params) -> DataFrame:
    """Persons with any listed code in any domain."""
    listed = codes.select(F.col("concept_id").alias("_key")).distinct()
    rows = event.select("person_id", match_key(p).alias("_key"))
    return rows.join(listed, "_key", "left_semi").select("person_id").distinct()


def _demographics(person: DataFrame) -> DataFrame:
    day = F.coalesce("day_of_birth", F.lit(1))
    return person.withColumn("date_of_birth", birth_date(day)).select(
        "person_id", "gender_concept_name", "date_of_birth"
    )


def cases(person: DataFrame, with_code: DataFrame) -> DataFrame:
    return _demographics(person.join(with_code, "person_id", "left_semi"))


def controls(person: DataFrame, with_code: DataFrame) -> DataFrame:
    return _demographics(person.join(with_code, "person_id", "left_anti"))


# a day and a record id in one decimal, by day and then by id; a missing day or id comes first
_ID_PLACES = "100000000000000000000"
_NO_DAY, _NO_ID = -10_000_000, "-10000000000000000000"
FIRST_KEYS = ["person_id", "concept_id", "domain", "concept_name"]


def _day_and_id() -> Column:
    wide = "decimal(38,0)"
    day = F.coalesce(F.date_diff("event_date", F.lit("1970-01-01").cast("date")), F.lit(_NO_DAY))
    number = F.coalesce(F.col("record_id").cast("decimal(20,0)"), F.lit(_NO_ID).cast("decimal(20,0)"))
    return (day.cast("decimal(10,0)") * F.lit(_ID_PLACES).cast("decimal(21,0)") + number).cast(wide)


def first_records(event: DataFrame) -> DataFrame:
    """Per person, concept, domain and name the earliest day and record: all that the statistics need of a
    set of events. Sets put together (`merge_first_records`) give what all their events at once would.

    The event table is reduced by a hash aggregate, as its only buffer is a number; the strings of a
    record are keys.
    """
    return event.groupBy(*FIRST_KEYS).agg(F.min(_day_and_id()).alias("first_record"))


def merge_first_records(firsts: DataFrame) -> DataFrame:
    """One row per key out of rows of several sets. A set that comes twice changes nothing."""
    return firsts.groupBy(*FIRST_KEYS).agg(F.min("first_record").alias("first_record"))


def earliest(firsts: DataFrame) -> DataFrame:
    """The earliest record of each person and concept, over all domains; of equal days the first by
    domain, record id and name. Settled on the few rows that a person and concept then have, gathered
    as they are: the strings of the least row would need a sort on both sides of the shuffle, and hardly
    any row goes before it. Rows of several sets need not be merged before. Gathered by person alone, as all
    later joins are; concepts and their names, not events, bound the rows that a person has here."""
    half = F.lit(_ID_PLACES).cast("decimal(21,0)") / 2
    day = F.floor((F.col("first_record") + half) / F.lit(_ID_PLACES).cast("decimal(21,0)")).cast("int")
    visit_date = F.when(day > _NO_DAY, F.date_add(F.lit("1970-01-01").cast("date"), day))
    record = F.struct(visit_date.alias("visit_date"), "domain", "first_record", "concept_name")
    return (
        firsts.repartition("person_id")
        .groupBy("person_id", "concept_id")
        .agg(F.min(record).alias("r"))
        .select("person_id", "concept_id", "r.concept_name", "r.visit_date", "r.domain")
    )


def person_concepts(event: DataFrame) -> DataFrame:
    """The earliest record of each person and concept of the events."""
    return earliest(first_records(event))


def coded_persons(concepts: DataFrame, codes: DataFrame) -> DataFrame:
    """Persons with any listed concept, from the rows per person and concept: the events need no second
    pass where drugs match on the concept as well."""
    listed = codes.select("concept_id").distinct()
    return concepts.join(listed, "concept_id", "left_semi").select("person_id").distinct()


def concept_ages(concepts: DataFrame, persons: DataFrame) -> DataFrame:
    """Each person's concepts with the age in years at the record."""
    return (
        concepts.join(persons, "person_id")
        .withColumn("date_diff", F.date_diff("visit_date", "date_of_birth"))
        .withColumn("age", F.col("date_diff") / 365)
    )


def reproductive_age(aged: DataFrame, p: Params) -> DataFrame:
    return aged.filter(
        (F.col("gender_concept_name") == "FEMALE") & (F.col("age") >= p.min_age) & (F.col("age") < p.max_age)
    )


def concept_counts(rows: DataFrame, name: str) -> DataFrame:
    """Per concept its persons, and in ``new_persons`` those of them whose first row it is, so
    that ``new_persons`` adds up to all persons. Rows are one per person and concept.

    One pass over the rows; the result has a row per concept and is written out, as both the
    counts and the total read it. The rows come sorted by person from the join before, which
    the running number reuses.
    """
    first = F.row_number().over(Window.partitionBy("person_id").orderBy("person_id")) == 1
    return cut(
        rows.withColumn("_first", first.cast("int"))
        .groupBy("concept_id", "concept_name")
        .agg(F.count("person_id").alias(name), F.sum("_first").alias("new_persons"))
    )


def _persons_total(counts: DataFrame) -> Column:
    return counts.agg(F.sum("new_persons").alias("persons")).scalar()


def case_prevalence(rows: DataFrame) -> DataFrame:
    """Per concept the distinct persons and their share of all."""
    counts = concept_counts(rows, "count")
    return (
        counts.filter((F.col("concept_id") != 0) & F.col("concept_name").isNotNull())
        .withColumn("proportion", F.try_divide(F.col("count"), _persons_total(counts)))
        .drop("new_persons")
    )


def frequent(prevalence: DataFrame, p: Params) -> DataFrame:
    return prevalence.filter(F.col("count") > p.min_persons)


def control_prevalence(rows: DataFrame) -> DataFrame:
    return concept_counts(rows, "count_controls")


def specificity(frequent_cases: DataFrame, control_counts: DataFrame) -> DataFrame:
    """Share among cases over share among controls; a concept no control has counts as one."""
    share = F.try_divide(F.col("count_controls"), _persons_total(control_counts))
    return (
        frequent_cases.join(control_counts.drop("concept_name", "new_persons"), "concept_id", "left")
        .withColumn("count_controls", F.coalesce("count_controls", F.lit(1).cast("bigint")))
        .withColumn("proportion_controls", share)
        .withColumn("ratio", F.try_divide(F.col("proportion"), F.col("proportion_controls")))
    )


def highly_specific(ratios: DataFrame, p: Params) -> DataFrame:
    return ratios.filter(F.col("ratio") > p.min_ratio)
