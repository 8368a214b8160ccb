"""Mapping of a code list to standard concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(codes: DataFrame, concept: DataFrame) -> DataFrame:
    """Listed codes with their category and all attributes of the concept table."""
    return codes.select("concept_id", "category").join(concept, "concept_id")


def non_standard(found: DataFrame) -> DataFrame:
    return found.filter(F.col("standard_concept").isNull())


def standard(found: DataFrame) -> DataFrame:
    return found.filter(F.col("standard_concept") == "S")


def maps_to(codes: DataFrame, concept_relationship: DataFrame) -> DataFrame:
    """The codes' "Maps to" relationships."""
    links = concept_relationship.filter(F.col("relationship_id") == "Maps to").drop(
        "valid_start_date", "valid_end_date", "invalid_reason"
    )
    return codes.join(links, F.col("concept_id") == F.col("concept_id_1"))


def mapped_attributes(mapped: DataFrame, concept: DataFrame) -> DataFrame:
    """Attributes of the mapped-to concepts, under the category of the code they come from."""
    targets = mapped.select(F.col("concept_id_2").alias("concept_id"), "category")
    return targets.join(concept, "concept_id")


def standardize(codes: DataFrame, concept: DataFrame, concept_relationship: DataFrame) -> DataFrame:
    """Standard codes as they are and non-standard ones mapped; duplicates are kept."""
    found = lookup(codes, concept)
    mapped = mapped_attributes(maps_to(non_standard(found), concept_relationship), concept)
    return standard(found).unionByName(mapped)
