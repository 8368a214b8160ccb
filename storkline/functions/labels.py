"""Labels for precision, race and ethnicity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bound in days (inclusive) and label, from narrow to wide.
PRECISION = ((7, "week"), (14, "two-week"), (21, "three-week"), (28, "month"), (56, "two-month"), (84, "three-month"))
WEAK_WEEK = "week_poor-support"
NON_SPECIFIC = "non-specific"

# Race names by group.
RACES = {
    "Asian": ("Asian", "Asian Indian", "Chinese", "Korean", "Vietnamese", "Filipino", "Japanese"),
    "Black": ("Black", "Black or African American"),
    "Native Hawaiian or Other Pacific Islander": (
        "Other Pacific Islander", "Native Hawaiian or Other Pacific Islander", "Polynesian",
    ),
    "Unknown": ("No information", "No matching concept", "Refuse to answer", "Unknown", "Unknown racial group"),
    "White": ("White",),
}
HISPANIC, NOT_HISPANIC = "Hispanic or Latino", "Not Hispanic or Latino"


def precision_label(days: Column) -> Column:
    label = F.lit(NON_SPECIFIC)
    for bound, name in reversed(PRECISION):
        label = F.when((days >= 0) & (days <= bound), name).otherwise(label)
    return F.when(days == -1, WEAK_WEEK).otherwise(label)


def race_group(race: Column) -> Column:
    label = F.when(race.isNull(), "Unknown").otherwise("Other")
    for name, members in RACES.items():
        label = F.when(race.isin(*members), name).otherwise(label)
    return label


def ethnicity_group(ethnicity: Column, race: Column) -> Column:
    return (
        F.when(ethnicity.isin(HISPANIC, NOT_HISPANIC), ethnicity)
        .when(race == "Hispanic", HISPANIC)
        .otherwise("Unknown")
    )


def race_ethnicity(race: Column, ethnicity: Column) -> Column:
    return (
        F.when(ethnicity == HISPANIC, f"{HISPANIC} Any Race")
        .when(race == "Unknown", "Unknown")
        .otherwise(F.concat_ws(" ", race, F.lit("Non-Hispanic")))
    )
