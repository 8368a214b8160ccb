"""Timing branch: episodes from how well the gaps between records fit their expected months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storkline.config import Params
from storkline.functions.intervals import join_days
from storkline.functions.rows import first_row
from storkline.operators.cohort import women

# behind every position of a person
LAST_POSITION = 2147483647
RECORD = ["person_id", "event_date", "concept_id", "concept_name", "domain"]
# order of a person's records; equal dates are settled by concept, then name and domain
RECORD_ORDER = ["event_date", "concept_id", "concept_name", "domain"]


def _records(event: DataFrame, visit: DataFrame) -> DataFrame:
    """Records of conditions, procedures, observations, measurements and visits."""
    visits = visit.select(
        "person_id", F.col("visit_start_date").alias("event_date"), F.col("visit_concept_id").alias("concept_id"),
        F.col("visit_concept_name").alias("concept_name"), F.lit("visit").alias("domain"),
    )
    return event.filter(F.col("domain") != "drug").select(*RECORD).unionByName(visits)


def _timed(rows: DataFrame, months: DataFrame) -> DataFrame:
    codes = months.select(F.col("domain_concept_id").alias("concept_id")).distinct()
    return rows.join(codes, "concept_id", "left_semi").select(*RECORD).distinct()


def match_domains(event: DataFrame, visit: DataFrame, months: DataFrame) -> DataFrame:
    """Distinct records of timed concepts in all five domains, at any time."""
    return _timed(_records(event, visit), months)


def timed_records(event: DataFrame, visit: DataFrame, months: DataFrame, p: Params) -> DataFrame:
    """Distinct records of timed concepts in the study window, visits included, drugs not."""
    rows = _records(event, visit)
    inside = (F.col("event_date") > F.lit(p.study_start)) & (F.col("event_date") <= F.lit(p.study_end))
    return _timed(rows.filter(inside), months)


def month_lookup(months: DataFrame) -> DataFrame:
    """One month range per concept; of several the one with the largest months counts."""
    return first_row(
        months.select(F.col("domain_concept_id").alias("concept_id"),
                      F.col("min_month").cast("double").alias("min_month"),
                      F.col("max_month").cast("double").alias("max_month")),
        ["concept_id"], [F.col("max_month").desc_nulls_last(), F.col("min_month").desc_nulls_last()],
    )


def timeline(records: DataFrame, months: DataFrame, person: DataFrame, p: Params) -> DataFrame:
    """Each woman's records in date order with their month range, position and gap in days.

    The distinct records bound a person's rows by study days times timed concepts.
    """
    by_person = Window.partitionBy("person_id")
    w = by_person.orderBy(*RECORD_ORDER)
    return (
        records.join(month_lookup(months), "concept_id")
        .repartition("person_id")
        .join(women(person, p).select("person_id"), "person_id", "left_semi")
        .withColumns({
            "position": F.row_number().over(w),
            "gap_days": F.date_diff("event_date", F.lag("event_date").over(w)),
            "records": F.count(F.lit(1)).over(by_person),
        })
    )


def _fits(later: str, earlier: str, p: Params) -> Column:
    """The days between two records lie in the range their months allow, with tolerance."""
    months = F.date_diff(f"{later}.event_date", f"{earlier}.event_date") / 30
    most = (F.col(f"{later}.max_month") - F.col(f"{earlier}.min_month")) + p.month_tolerance
    least = (F.col(f"{later}.min_month") - F.col(f"{earlier}.max_month")) - p.month_tolerance
    return (most >= months) & (months >= least)


def undecided(p: Params) -> Column:
    """Only after such a gap does agreement decide: a shorter one never starts an episode,
    a longer one always does."""
    gap_months = F.col("gap_days") / 30
    return (gap_months > p.new_episode_months) & (gap_months <= p.split_months)


def _widest_days(months: Column) -> Column:
    """The most days whose thirtieth is at most so many months."""
    near = F.floor(months * 30)
    return F.when((near + 1) / 30 <= months, near + 1).when(near / 30 <= months, near).otherwise(near - 1).cast("int")


def _fewest_days(months: Column) -> Column:
    """The fewest days whose thirtieth is at least so many months."""
    return -_widest_days(-months)


RANGES = ["min_month", "max_month"]


def fits_earlier(ordered: DataFrame, asked: DataFrame, months: DataFrame, p: Params) -> DataFrame:
    """The asked records (person_id, position, event_date and month range) with ``fits``: does an earlier
    record of the person fit them?

    The code list has few different month ranges. For an asked record and each of them the fitting days
    are one stretch, and what counts is whether the last record of that range up to the stretch's end
    lies in it. All those questions and the records stand in one window by person and range, so the
    rows are the records plus as many questions for each asked one as there are ranges.
    """
    known = month_lookup(months).select(*RANGES).filter("min_month is not null and max_month is not null").distinct()
    ranges = known.agg(F.collect_set(F.struct(*RANGES)).alias("ranges")).scalar()
    low, high = F.col("range.min_month"), F.col("range.max_month")
    questions = (
        asked.select("person_id", "position", "event_date", *RANGES)
        .filter("min_month is not null and max_month is not null and event_date is not null")
        .withColumn("range", F.explode(ranges))
        .withColumn("first", F.date_sub("event_date", _widest_days((F.col("max_month") - low) + p.month_tolerance)))
        .withColumn("last", F.date_sub("event_date", _fewest_days((F.col("min_month") - high) - p.month_tolerance)))
        # of the record's own day only earlier positions count
        .withColumn("before", F.when(F.col("last") >= F.col("event_date"), F.col("position")).otherwise(F.lit(LAST_POSITION)))
        .withColumn("day", F.least("last", "event_date"))
        .filter(F.col("first") <= F.col("day"))
        .select("person_id", low.alias("min_month"), high.alias("max_month"), "day", "before", F.lit(0).alias("is_record"), "position", "first")
    )
    records = ordered.filter("event_date is not null").select(
        "person_id", *RANGES, F.col("event_date").alias("day"), F.col("position").alias("before"), F.lit(1).alias("is_record"),
        F.lit(None).cast("int").alias("position"), F.lit(None).cast("date").alias("first"),
    )
    w = Window.partitionBy("person_id", *RANGES).orderBy("day", "before", "is_record").rowsBetween(Window.unboundedPreceding, 0)
    latest = F.max(F.when(F.col("is_record") == 1, F.col("day"))).over(w)
    found = (
        records.unionByName(questions).withColumn("latest", latest)
        .filter((F.col("is_record") == 0) & (F.col("latest") >= F.col("first")))
        .select("person_id", "position").distinct().withColumn("fits", F.lit(True))
    )
    return asked.join(found, ["person_id", "position"], "left").withColumn("fits", F.coalesce("fits", F.lit(False)))


def fits_around(ordered: DataFrame, asked: DataFrame, months: DataFrame, p: Params) -> DataFrame:
    """Those of the asked records (with ``records``, the person's number of them) for which two records the
    same number of positions before and after fit each other.

    Such two are no further apart than the widest month range, so an asked record meets the records of
    those months only.
    """
    reach = months.agg((F.max("max_month") - F.min("min_month") + p.month_tolerance).alias("reach")).scalar()
    spans = asked.select(
        "person_id", F.col("position").alias("asked"), "records", F.date_sub("event_date", _widest_days(reach)).alias("from_day"),
        F.col("event_date").alias("to_day"),
    )
    rows = ordered.select("person_id", "position", "event_date", *RANGES)
    before = (
        join_days(rows, "event_date", spans, "from_day", "to_day")
        .withColumn("mirror", 2 * F.col("asked") - F.col("position"))
        .filter((F.col("position") < F.col("asked")) & (F.col("mirror") <= F.col("records")))
    )
    pairs = before.alias("e").join(
        rows.alias("l"),
        (F.col("e.person_id") == F.col("l.person_id")) & (F.col("e.mirror") == F.col("l.position")) & _fits("l", "e", p),
    )
    return pairs.select("e.person_id", F.col("e.asked").alias("position")).distinct()


def agreement(ordered: DataFrame, months: DataFrame, p: Params, asked_for: Column | None = None) -> DataFrame:
    """For each record, or those asked for: does it fit any earlier record, or do two records the
    same number of positions before and after it fit each other?

    Pairs are formed for records that fit no earlier one alone. Such a record has none of its own month
    range within the months before it that the range allows, so a person has few, however many records.
    """
    asked = ordered.filter(F.lit(True) if asked_for is None else asked_for)
    base = ["person_id", "position", "event_date", *RANGES, "records"]
    direct = fits_earlier(ordered, asked.select(*base), months, p)
    around = fits_around(ordered, direct.filter(~F.col("fits")), months, p).withColumn("_around", F.lit(True))
    return direct.join(around, ["person_id", "position"], "left").select(
        "person_id", "position", "event_date", (F.col("fits") | F.coalesce("_around", F.lit(False))).alias("agrees")
    )


def split_episodes(ordered: DataFrame, months: DataFrame, p: Params) -> DataFrame:
    """Number each person's episodes: a new one starts after a long gap, or an undecided one
    without agreement."""
    agrees = agreement(ordered, months, p, undecided(p)).select("person_id", "position", "agrees")
    w = Window.partitionBy("person_id").orderBy("position")
    starts = (F.col("gap_days") / 30 > p.split_months) | ~F.col("agrees")
    return (
        ordered.join(agrees, ["person_id", "position"], "left")
        .withColumn("starts", F.coalesce(starts, F.lit(False)))
        .withColumn("episode", (F.sum(F.col("starts").cast("int")).over(w) + 1).cast("int"))
    )


def drop_long_episodes(split: DataFrame, p: Params) -> DataFrame:
    """Remove episodes longer than a pregnancy can be recorded and renumber the rest."""
    w = Window.partitionBy("person_id", "episode")
    span = F.date_diff(F.max("event_date").over(w), F.min("event_date").over(w)) / 30
    renumber = F.dense_rank().over(Window.partitionBy("person_id").orderBy("episode"))
    return (
        split.withColumn("_span", span)
        .filter(F.col("_span") <= p.max_span_months)
        .withColumn("episode", renumber)
        .drop("_span")
    )


def drop_frequent_persons(kept: DataFrame, p: Params) -> DataFrame:
    """Remove persons with too many episodes per year of the whole cohort's period."""
    days = kept.agg(F.date_diff(F.max("event_date"), F.min("event_date")).alias("days")).scalar()
    most = F.max("episode").over(Window.partitionBy("person_id"))
    return (
        kept.withColumn("_rate", F.try_divide(most, F.try_divide(days, F.lit(365))))
        .filter(F.col("_rate") < p.max_episodes_per_year)
        .drop("_rate")
    )


def episode_bounds(kept: DataFrame, p: Params) -> DataFrame:
    """First and last day of each episode, and the latest day a pregnancy behind its last
    record can reach."""
    last = F.struct("event_date", "max_month", (-F.col("min_month")).alias("low"))
    return (
        kept.groupBy("person_id", F.col("episode").alias("person_episode_number"))
        .agg(
            F.min("event_date").alias("episode_min_date"),
            F.max("event_date").alias("episode_max_date"),
            F.max(last).alias("_last"),
        )
        .withColumn("episode_max_date_plus_two_months", F.add_months("episode_max_date", p.episode_tail_months))
        .withColumn(
            "max_pregnancy_date",
            F.add_months("episode_max_date", (p.lookahead_months + F.col("_last.low")).cast("int")),
        )
        .drop("_last")
    )
