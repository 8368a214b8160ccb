"""Outcome branch: one visit per day and outcome, spaced, then admitted to one timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storkline.config import NO_OUTCOME, OUTCOMES
from storkline.functions.rows import first_row

# Outcome group -> categories read as that group, in order of admission to the timeline.
GROUPS = {"LB": ("LB",), "SB": ("SB",), "ECT": ("ECT",), "AB": ("AB", "SA"), "DELIV": ("DELIV",)}
ADMISSION = ("SB", "ECT", "AB", "DELIV")


def outcome_group() -> Column:
    """AB stands for AB and SA; a category that is no outcome gives null."""
    result = F.lit(None).cast("string")
    for group, categories in GROUPS.items():
        result = F.when(F.col("category").isin(*categories), group).otherwise(result)
    return result


def outcome_visits(coded: DataFrame, group: str | None = None) -> DataFrame:
    """One row per person, outcome group and day."""
    wanted = GROUPS[group] if group else [c for cats in GROUPS.values() for c in cats]
    rows = coded.filter(F.col("category").isin(*wanted)).withColumn("outcome_group", outcome_group())
    return first_row(
        rows,
        ["person_id", "outcome_group", "visit_date"],
        ["category", "concept_id", "concept_name", "data_partner_id", "gest_value", "value_as_number"],
    )


def visit_gaps(visits: DataFrame) -> DataFrame:
    """Days since the person's previous visit of the same outcome group."""
    w = Window.partitionBy("person_id", "outcome_group").orderBy("visit_date")
    return visits.withColumn("days", F.date_diff("visit_date", F.lag("visit_date").over(w)))


def limit_days(limits: DataFrame) -> Column:
    """Minimum gaps as a map (first>outcome -> days), read once as a scalar subquery. The five
    groups bound it to 25 entries."""
    known = limits.filter(F.col("first_preg_category").isin(*GROUPS) & F.col("outcome_preg_category").isin(*GROUPS))
    pairs = F.struct(F.concat_ws(">", "first_preg_category", "outcome_preg_category"), "min_days")
    return known.agg(F.map_from_entries(F.collect_list(pairs)).alias("limits")).scalar()


def spaced_visits(gaps: DataFrame, limits: DataFrame) -> DataFrame:
    """First visit of each group, and visits at least the minimum days after the visit before."""
    own = F.try_element_at(limit_days(limits), F.concat_ws(">", "outcome_group", "outcome_group"))
    return gaps.filter(F.col("days").isNull() | (F.col("days") >= own)).drop("days")


def start_timeline(spaced: DataFrame) -> DataFrame:
    """All spaced visits; live births are placed from the start, the rest wait for admission."""
    return spaced.withColumn("placed", F.col("outcome_group") == "LB")


def admit(timeline: DataFrame, group: str, days: Column) -> DataFrame:
    """Place the group's visits whose gaps to the placed neighbours are long enough.

    Neighbours are the visits next to a candidate among placed visits and all candidates of
    the group. A candidate between a placed visit and another candidate is left out.
    ``days`` holds the minimum gaps, see ``limit_days``.
    """
    taking_part = F.col("placed") | (F.col("outcome_group") == group)
    w = Window.partitionBy("person_id", "_in").orderBy("visit_date", "outcome_group", "concept_id")

    # stillbirth shares the live-birth gap before a candidate; abortion shares the ectopic gap
    before = F.when(F.col("_prev").isin("LB", "SB"), "LB").otherwise("ECT")
    after = F.when(F.col("_next").isin("LB", "SB"), F.col("_next")).otherwise("ECT")
    need_before = F.try_element_at(days, F.concat(before, F.lit(f">{group}")))
    need_after = F.try_element_at(days, F.concat(F.lit(f"{group}>"), after))

    prev_placed = F.col("_prev").isNotNull() & (F.col("_prev") != group)
    next_placed = F.col("_next").isNotNull() & (F.col("_next") != group)
    prev_ok = ~prev_placed | (F.date_diff("visit_date", "_prev_date") >= need_before)
    next_ok = ~next_placed | (F.date_diff("_next_date", "visit_date") >= need_after)
    one_sided = F.col("_prev").isNotNull() & F.col("_next").isNotNull() & (prev_placed != next_placed)

    return (
        timeline.withColumn("_in", taking_part)
        .withColumns({
            "_prev": F.lag("outcome_group").over(w),
            "_prev_date": F.lag("visit_date").over(w),
            "_next": F.lead("outcome_group").over(w),
            "_next_date": F.lead("visit_date").over(w),
        })
        .withColumn(
            "placed",
            F.when(F.col("outcome_group") == group, F.coalesce(prev_ok & next_ok & ~one_sided, F.lit(False)))
            .otherwise(F.col("placed")),
        )
        .drop("_in", "_prev", "_prev_date", "_next", "_next_date")
    )


def admit_through(spaced: DataFrame, limits: DataFrame, last: str = "DELIV") -> DataFrame:
    """Admit the groups in order up to ``last``; one frame and one shuffle serve all of them."""
    timeline, days = start_timeline(spaced), limit_days(limits)
    for group in ADMISSION[: ADMISSION.index(last) + 1]:
        timeline = admit(timeline, group, days)
    return timeline.filter("placed").drop("placed", "gest_value", "value_as_number")


def term_rules(terms: DataFrame) -> DataFrame:
    """Term durations of the known categories: one row each, so always fit to broadcast. Two rows for
    a category are an error."""
    twice = F.raise_error(F.concat(F.lit("more than one term rule for category "), F.col("category")))
    days = [
        F.when(F.count(F.lit(1)) > 1, twice).otherwise(F.max(F.col(c).cast("int"))).alias(c) for c in ("min_term", "max_term", "retry")
    ]
    known = terms.filter(F.col("category").isin(*OUTCOMES, NO_OUTCOME))
    return F.broadcast(known.groupBy("category").agg(*days))


def start_bounds(outcomes: DataFrame, terms: DataFrame) -> DataFrame:
    """Earliest and latest start of each outcome from the term durations of its category."""
    return outcomes.join(term_rules(terms), "category", "left").withColumns({
        "min_start_date": F.date_sub("visit_date", F.col("min_term")),
        "max_start_date": F.date_sub("visit_date", F.col("max_term")),
    })
