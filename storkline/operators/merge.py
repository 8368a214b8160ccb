"""Outcomes for the timing branch, and the merge of both branches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storkline.config import OUTCOME_PRIORITY, OUTCOMES, Params
from storkline.functions.intervals import join_days
from storkline.functions.rows import birth_date, first_row

EPISODE = ["person_id", "person_episode_number"]
WINDOW = ["episode_min_date", "episode_max_date", "lookback_date", "lookahead_date"]
# Fixed value: the next-episode date of a person's last episode.
NO_NEXT_EPISODE = "2999-01-01"


def outcome_concepts(codes: DataFrame) -> DataFrame:
    """Codes of the six outcomes."""
    return codes.filter(F.col("category").isin(*OUTCOMES)).select("concept_id", "concept_name", "category").distinct()


def next_episode(bounds: DataFrame) -> DataFrame:
    """Day before the person's next episode, or a day far ahead."""
    w = Window.partitionBy("person_id").orderBy("person_episode_number")
    following = F.date_sub(F.lead("episode_min_date").over(w), 1)
    return bounds.withColumn(
        "next_closest_episode_date", F.coalesce(following, F.lit(NO_NEXT_EPISODE).cast("date"))
    )


def search_windows(bounds: DataFrame, p: Params) -> DataFrame:
    """Where to look for each episode's outcome."""
    return (
        next_episode(bounds).withColumns({
            "lookback_date": F.date_sub("episode_max_date", p.lookback_days),
            "lookahead_date": F.least("next_closest_episode_date", "max_pregnancy_date"),
        })
    )


def outcome_candidates(event: DataFrame, codes: DataFrame, windows: DataFrame) -> DataFrame:
    """Outcome records inside the windows. Equal records are counted before the join, so a
    person holds at most one row per day, concept and name when the rows are gathered."""
    outcomes = outcome_concepts(codes).select("concept_id", "category").distinct()
    records = (
        event.filter(F.col("domain") != "drug")
        .select("person_id", "event_date", "concept_id", "concept_name")
        .join(outcomes, "concept_id")
        .groupBy("person_id", "event_date", "concept_id", "concept_name", "category")
        .agg(F.count(F.lit(1)).alias("n_records"))
    )
    return join_days(records, "event_date", windows.select(*EPISODE, *WINDOW), "lookback_date", "lookahead_date")


def outcome_entries(candidates: DataFrame) -> DataFrame:
    """Per episode the sorted distinct entries (date, concept, name, category) with their counts;
    an entry with an unknown part is left out."""
    entry = ["event_date", "concept_id", "concept_name", "category"]
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in entry])
    return (
        candidates.filter(known)
        .groupBy(*EPISODE, *WINDOW, *entry)
        .agg(F.sum("n_records").alias("n_records"))
        .groupBy(*EPISODE, *WINDOW)
        .agg(F.sort_array(F.collect_list(F.struct(*entry, "n_records"))).alias("outcomes"))
    )


def first_dates(candidates: DataFrame, p: Params) -> DataFrame:
    """Per episode the first date of each category."""
    known = F.col("concept_name").isNotNull()  # an unnamed record never counts as an outcome
    text = F.concat_ws(",", F.col("event_date").cast("string"), "concept_id", "concept_name", "category")

    def has(category: str) -> Column:
        return known & (text.contains(category) if p.category_by_text else F.col("category") == category)

    return candidates.groupBy(*EPISODE, *WINDOW).agg(
        *[F.min(F.when(has(c), F.col("event_date"))).alias(f"{c}_date") for c in OUTCOMES]
    )


def pick_outcome(dates: DataFrame) -> DataFrame:
    """The first category in priority order that has a date."""
    dated = [F.col(f"{c}_date") for c in OUTCOME_PRIORITY]
    names = [F.when(d.isNotNull(), c) for c, d in zip(OUTCOME_PRIORITY, dated, strict=True)]
    return dates.withColumns({"pps_category": F.coalesce(*names), "pps_outcome_date": F.coalesce(*dated)})


def add_outcomes(bounds: DataFrame, picked: DataFrame) -> DataFrame:
    keys = [*EPISODE, "episode_min_date"]
    return bounds.select(
        *EPISODE, "episode_min_date", "episode_max_date", "episode_max_date_plus_two_months"
    ).join(picked.select(*keys, "pps_category", "pps_outcome_date"), keys, "left")


def _merged_dates(df: DataFrame) -> DataFrame:
    return (
        df.withColumns({
            "merged_episode_start": F.least("first_gest_date", "episode_min_date", "pregnancy_end"),
            "merged_episode_end": F.greatest("episode_max_date", "pregnancy_end"),
        })
        .withColumn("merged_episode_length", F.months_between("merged_episode_end", "merged_episode_start"))
    )


def _intervals_meet() -> Column:
    """Overlap of [pregnancy_start, pregnancy_end] and [episode_min, episode_max + 2 months],
    in a form that also covers a first interval whose start lies after its end."""
    a, b = F.col("pregnancy_start"), F.col("pregnancy_end")
    c, d = F.col("episode_min_date"), F.col("episode_max_date_plus_two_months")
    return (
        a.between(c, d) | b.between(c, d) | c.between(a, b) | d.between(a, b) | ((a > c) & (b < d))
    )


def overlap_join(hip: DataFrame, pps: DataFrame) -> DataFrame:
    """Every overlapping pair of episodes and each side's rows without a partner, with a flag
    per side for episodes that met more than one partner."""
    first = hip.select(
        F.col("person_id").alias("hip_person"), F.col("episode").alias("hip_episode"),
        F.col("visit_date").alias("pregnancy_end"), F.col("estimated_start_date").alias("pregnancy_start"),
        F.col("gest_date").alias("first_gest_date"), "category",
    )
    second = pps.withColumnRenamed("person_id", "pps_person").withColumnRenamed("person_episode_number", "pps_episode")
    df = (
        first.join(second, (F.col("hip_person") == F.col("pps_person")) & _intervals_meet(), "full_outer")
        .withColumn("person_id", F.coalesce("hip_person", "pps_person"))
        .drop("hip_person", "pps_person")
        .repartition("person_id")  # one shuffle for the steps per person and side that follow
    )
    return _merged_dates(_mark_repeats(df))


def _repeated(side: str) -> Column:
    """1 for a repeated episode of that side, 0 for a single one, null where the side is missing."""
    n = F.count(F.lit(1)).over(Window.partitionBy("person_id", side))
    return F.when(F.col(side).isNotNull(), (n > 1).cast("int"))


def _mark_repeats(df: DataFrame) -> DataFrame:
    return df.withColumns({"hip_dup": _repeated("hip_episode"), "pps_dup": _repeated("pps_episode")})


HIP_SIDE = ["hip_episode", "pregnancy_end", "pregnancy_start", "first_gest_date", "category"]
PPS_SIDE = ["pps_episode", "episode_min_date", "episode_max_date", "pps_category", "pps_outcome_date"]


def _clear(df: DataFrame, columns: list[str], when: Column) -> DataFrame:
    gone = F.coalesce(when, F.lit(False))
    df = df.withColumn("_gone", gone)
    return df.withColumns({c: F.when(~F.col("_gone"), F.col(c)) for c in columns}).drop("_gone")


def _best(value: Column, side: str, pick=F.min) -> Column:
    """Best value among the rows of one episode; null where the side is missing."""
    return F.when(F.col(side).isNotNull(), pick(value).over(Window.partitionBy("person_id", side)))


def dedupe_overlaps(joined: DataFrame) -> DataFrame:
    """Take apart pairs of episodes that met several partners.

    In turn: nearest end per outcome-side episode, longest timing-side episode, nearest end
    per timing-side episode, then the latest end. All steps go by the repeat flags of the join.
    """
    cols = ["person_id", *HIP_SIDE, *PPS_SIDE]
    df = joined.select(*cols, "hip_dup", "pps_dup")
    once = (F.coalesce("hip_dup", F.lit(0)) == 0) & (F.coalesce("pps_dup", F.lit(0)) == 0)
    hip_dup, pps_dup = F.col("hip_dup") != 0, F.col("pps_dup") != 0
    apart = F.abs(F.date_diff("pregnancy_end", "episode_max_date"))
    length = F.abs(F.date_diff("episode_max_date", "episode_min_date"))

    df = df.withColumn("_single", once)
    df = _clear(df, HIP_SIDE, hip_dup & (apart != _best(apart, "hip_episode")))
    df = _clear(df, HIP_SIDE + PPS_SIDE, hip_dup & (length != _best(length, "hip_episode", F.max)))
    df = _clear(
        df, PPS_SIDE, pps_dup & (F.col("pregnancy_end").isNull() | (apart != _best(apart, "pps_episode")))
    )
    latest = _best(F.col("pregnancy_end"), "pps_episode", F.max)
    df = _clear(df, PPS_SIDE, pps_dup & (F.col("pregnancy_end") != latest))

    df = first_row(
        df, ["person_id", "hip_episode", "episode_min_date", "episode_max_date", "_single"],
        ["pps_episode", "pps_category", "pps_outcome_date", "pregnancy_end"],
    ).drop("hip_dup", "pps_dup")
    df = _merged_dates(_mark_repeats(df))
    order = ["merged_episode_start", "merged_episode_end", "hip_episode", "pps_episode"]
    return (
        df.withColumn("episode_num", F.row_number().over(Window.partitionBy("person_id").orderBy(*order)))
        .filter(F.col("merged_episode_start").isNotNull())
        .drop("_single")
    )


def episode_detail(merged: DataFrame, person: DataFrame) -> DataFrame:
    """Flags of the branches, recorded dates, demographics and a fresh episode number."""
    people = person.select(
        "person_id", "data_partner_id", "year_of_birth", "month_of_birth", "race_concept_name",
        "ethnicity_concept_name", "location_id",
    )
    order = ["recorded_episode_start", "recorded_episode_end", "_hip", "_pps"]
    return (
        merged.select(
            "person_id",
            F.col("hip_episode").isNotNull().cast("int").alias("hip_flag"),
            F.col("pps_episode").isNotNull().cast("int").alias("pps_flag"),
            F.col("category").alias("hip_outcome_category"),
            F.col("pregnancy_end").alias("hip_end_date"),
            F.col("pps_category").alias("pps_outcome_category"),
            F.col("pps_outcome_date").alias("pps_end_date"),
            F.col("merged_episode_start").alias("recorded_episode_start"),
            F.col("merged_episode_end").alias("recorded_episode_end"),
            F.col("merged_episode_length").alias("recorded_episode_length"),
            F.col("hip_episode").alias("_hip"),
            F.col("pps_episode").alias("_pps"),
        )
        .join(people, "person_id", "left")
        .withColumn("date_of_birth", birth_date(F.lit(1)))
        .withColumn("episode_number", F.row_number().over(Window.partitionBy("person_id").orderBy(*order)))
        .drop("_hip", "_pps")
    )
