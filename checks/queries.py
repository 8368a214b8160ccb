"""One entry per operator: how Spark computes it, which oracle expression answers it, and the
columns compared. Column tags: ``d`` date, ``f`` fraction, ``b`` boolean; dates and booleans are
rendered alike on both sides and fractions rounded to 6 digits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import oracle
from checks.fixture import PARAMS, load
from storkline.operators import (
    cohort, concepts, gestation, loads, merge, metadata, outcomes, pps, prevalence, reconcile, start_dates, timing,
)
from storkline.plans.pipeline import Pipeline
from storkline.session import cut, stage_path


class Steps(Pipeline):
    """The pipeline with every inner step reachable by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        tables, lists = load(spark, sf_dir)
        super().__init__(tables, lists, PARAMS)

    # concept mapping
    @cached_property
    def found(self):
        return concepts.lookup(self.lists.initial, self.tables.concept)

    @cached_property
    def links(self):
        return concepts.maps_to(concepts.non_standard(self.found), self.tables.concept_relationship)

    # prevalence
    @cached_property
    def with_code(self):
        return prevalence.persons_with_code(self.tables.event, self.standard_codes, self.p)

    @cached_property
    def per_person(self):
        return prevalence.person_concepts(self.tables.event)

    @cached_property
    def by_loads(self):
        """The statistics from two loads, the records from 1996 on before the older and undated ones."""
        event, folder = self.tables.event, stage_path(self.tables.event.sparkSession)
        recent = F.coalesce(F.year("event_date") >= 1996, F.lit(False))
        loads.add_load(event.filter(recent), folder, "recent")
        loads.add_load(event.filter(~recent), folder, "late")
        return Pipeline(self.tables, self.lists, self.p, loads.loaded(event.sparkSession, folder))

    # outcomes
    @cached_property
    def cohort(self):
        return cohort.initial_cohort(self.tables.event, self.lists.outcomes, self.tables.person, self.p)

    def visits(self, group: str | None = None):
        # one row per day before the person join, as in the pipeline
        coded = cohort.coded_events(self.tables.event, self.lists.outcomes, self.p)
        return cohort.with_women(outcomes.outcome_visits(coded, group), self.tables.person, self.p)

    def gaps(self, group: str | None = None):
        return outcomes.visit_gaps(self.visits(group))

    def spaced(self, group: str | None = None):
        return outcomes.spaced_visits(self.gaps(group), self.lists.limits)

    def admitted(self, group: str):
        return outcomes.admit_through(self.spaced(), self.lists.limits, group)

    # gestation and reconciliation
    @cached_property
    def gest_visits(self):
        return gestation.gestation_visits(self.cohort, self.lists.ages)

    @cached_property
    def gest_episodes(self):
        coded = cohort.coded_events(self.tables.event, self.lists.outcomes, self.p)
        days = gestation.gestation_days(gestation.gestation_visits(coded, self.lists.ages), self.p)
        return gestation.gestation_episodes(cohort.with_women(days, self.tables.person, self.p), self.p)

    @cached_property
    def gest_bounds(self):
        return gestation.gestation_bounds(self.gest_episodes)

    @cached_property
    def attached(self):
        return reconcile.attach_gestation(self.outcome_timeline, self.gest_bounds, self.p)

    @cached_property
    def cleaned(self):
        return reconcile.clean_episodes(self.attached, self.p)

    @cached_property
    def unlapped(self):
        return reconcile.remove_overlaps(self.cleaned)

    # timing-specific concepts
    @cached_property
    def matched(self):
        return timing.match_concepts(self.tables.event, self.specific_concepts, self.p)

    # timing branch
    @cached_property
    def records(self):
        return pps.timed_records(self.tables.event, self.tables.visit, self.lists.months, self.p)

    @cached_property
    def line(self):
        return pps.timeline(self.records, self.lists.months, self.tables.person, self.p)

    @cached_property
    def split(self):
        return pps.split_episodes(cut(self.line), self.lists.months, self.p)

    @cached_property
    def short(self):
        return pps.drop_long_episodes(self.split, self.p)

    @cached_property
    def windows(self):
        return merge.search_windows(self.pps_bounds, self.p)

    @cached_property
    def candidates(self):
        return merge.outcome_candidates(self.evidence, self.lists.outcomes, self.windows)

    @cached_property
    def first_dates(self):
        return merge.first_dates(self.candidates, self.p)

    # merge
    @cached_property
    def joined(self):
        return merge.overlap_join(self.hip_episodes, self.pps_episodes)

    # start dates
    @cached_property
    def time_records(self):
        # as in the pipeline from the one pass, which the episodes rest on as well
        return start_dates.timing_records(self.evidence, self.lists.timing, self.lists.months)

    @cached_property
    def time_in(self):
        return start_dates.in_episodes(self.time_records, self.merged_episodes)

    @cached_property
    def time_value(self):
        return start_dates.week_value(self.time_in, self.p)

    @cached_property
    def time_start(self):
        return start_dates.week_start(self.time_value, self.lists.ages, self.p)

    @cached_property
    def timed(self):
        return start_dates.with_months(self.time_start, self.lists.months)

    @cached_property
    def classified(self):
        return start_dates.classify(self.timed)

    @cached_property
    def bounded(self):
        return start_dates.range_bounds(self.classified, self.p)

    @cached_property
    def evidence_rows(self):
        return start_dates.evidence(
            self.evidence, self.merged_episodes, self.lists.timing, self.lists.ages, self.lists.months, self.p
        )

    @cached_property
    def evidence_lists(self):
        return start_dates.evidence_lists(self.evidence_rows)

    @cached_property
    def outliers(self):
        return start_dates.range_outliers(self.evidence_lists)

    @cached_property
    def intersected(self):
        return start_dates.range_intersection(self.outliers)

    @cached_property
    def widened(self):
        return start_dates.widen_core(self.intersected, self.p)

    @cached_property
    def chosen(self):
        return start_dates.choose_start(self.widened, self.p)

    # final table
    @cached_property
    def m_timing(self):
        return metadata.with_timing(self.merged_episodes, self.timing_info)

    @cached_property
    def m_match(self):
        return metadata.outcome_match(self.m_timing, self.p)

    @cached_property
    def m_end(self):
        return metadata.episode_end(metadata.final_outcome(self.m_match, self.p), self.p)

    @cached_property
    def m_start(self):
        return metadata.fill_start(self.m_end, self.lists.terms)

    @cached_property
    def m_term(self):
        return metadata.term_flag(self.m_start, self.p)


@dataclass(frozen=True)
class Query:
    build: Callable[[Steps], DataFrame]
    source: str  # oracle expression
    columns: str  # "name" or "name:tag", space separated
    where: str = ""

    def _columns(self) -> list[tuple[str, str]]:
        return [tuple((c + ":").split(":")[:2]) for c in self.columns.split()]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.frame(Steps(spark, sf_dir))

    def frame(self, steps: Steps) -> DataFrame:
        def shown(name: str, tag: str) -> Column:
            c = F.col(name)
            if tag == "d":
                c = c.cast("date").cast("string")
            elif tag == "f":
                c = F.round(c.cast("double"), 6)
            elif tag == "b":
                c = c.cast("int")
            return c.alias(name)

        return self.build(steps).select(*[shown(n, t) for n, t in self._columns()])

    def sql(self) -> str:
        def shown(name: str, tag: str) -> str:
            text = {"d": f"CAST({name} AS VARCHAR)", "f": f"round(CAST({name} AS DOUBLE), 6)",
                    "b": f"CAST({name} AS INT)"}.get(tag, name)
            return f"{text} AS {name}"

        return oracle.select(self.source, ", ".join(shown(n, t) for n, t in self._columns()), self.where)


# -- columns compared ----------------------------------------------------------------------
CONCEPT = "concept_id category concept_name standard_concept"
LINK = "concept_id category concept_id_1 concept_id_2 relationship_id"
PERSON = "person_id gender_concept_name date_of_birth:d"
AGED = "person_id concept_id concept_name visit_date:d domain gender_concept_name date_of_birth:d date_diff age:f"
TRAITS = "data_partner_id year_of_birth race_concept_name ethnicity_concept_name"
CODED = f"person_id concept_id concept_name visit_date:d category gest_value value_as_number:f {TRAITS}"
VISIT = f"{CODED} outcome_group"
PLACED = f"person_id concept_id concept_name visit_date:d category outcome_group {TRAITS}"
RUN = ("person_id first_gest_date:d first_gest_week end_gest_date:d end_gest_week min_gest_week min_gest_date:d "
       f"min_gest_date_2:d max_gest_week max_gest_date:d episode {TRAITS}")
JOINED = ("person_id category visit_date:d concept_id concept_name min_term max_term retry min_start_date:d "
          "max_start_date:d first_gest_date:d first_gest_week end_gest_date:d end_gest_week min_gest_week "
          "min_gest_date:d min_gest_date_2:d max_gest_week max_gest_date:d max_gest_start_date:d days_diff "
          f"episode {TRAITS}")
CLEANED = f"{JOINED} removed_category removed_outcome gest_at_outcome"
HIP = f"person_id category visit_date:d estimated_start_date:d episode {TRAITS}"
MATCHED = "person_id domain domain_concept_id domain_concept_name domain_concept_start_date:d n_records"
IN_EPISODE = f"{MATCHED} episode start_date_of_pregnancy:d end_date:d category"
RECORD = "person_id event_date:d concept_id concept_name domain"
LINE = f"{RECORD} min_month:f max_month:f position gap_days"
BOUNDS = "person_id person_episode_number episode_min_date:d episode_max_date:d"
WINDOW = "lookback_date:d lookahead_date:d"
DATES = "LB_date:d SB_date:d ECT_date:d AB_date:d SA_date:d DELIV_date:d"
SIDES = ("person_id hip_episode pregnancy_end:d pregnancy_start:d first_gest_date:d category pps_episode "
         "episode_min_date:d episode_max_date:d pps_category pps_outcome_date:d hip_dup pps_dup "
         "merged_episode_start:d merged_episode_end:d merged_episode_length:f")
DETAIL = ("person_id episode_number data_partner_id year_of_birth month_of_birth race_concept_name "
          "ethnicity_concept_name location_id hip_flag pps_flag hip_outcome_category hip_end_date:d "
          "pps_outcome_category pps_end_date:d recorded_episode_start:d recorded_episode_end:d "
          "recorded_episode_length:f date_of_birth:d")
EPISODE = "person_id episode_number"
TIMED = f"{EPISODE} record_id domain concept_id concept_name event_date:d"
WEEKS = f"{TIMED} domain_value extrapolated_preg_start:d"
RANGES = f"{WEEKS} gt_type min_pregnancy_start:d max_pregnancy_start:d"
START = "inferred_episode_start:d precision_days"
FINAL = (f"{DETAIL} gw_flag gr3m_flag outcome_match final_outcome_category inferred_episode_start:d "
         "inferred_episode_end:d precision_days precision_category gestational_age_days_calculated "
         "term_duration_flag outcome_concordance_score birth_date_diff age_at_inferred_start:f race ethnicity "
         "race_ethnicity preterm_status_from_calculation")


def _joined_text(array: str, *fields: str, between: str = "/") -> Column:
    def item(x: Column) -> Column:
        return F.concat(F.concat_ws(between, *[x[f].cast("string") for f in fields]), F.lit("x"), x["n"].cast("string"))

    return F.array_join(F.transform(array, item), ";")


def _lists(s: Steps) -> DataFrame:
    return s.evidence_lists.withColumn("weeks", _joined_text("weeks", "start")).withColumn(
        "ranges", _joined_text("ranges", "start", "end")
    )


def _outcome_list(s: Steps) -> DataFrame:
    fields = ("event_date", "concept_id", "concept_name", "category", "n_records")
    entry = F.transform("outcomes", lambda x: F.concat_ws(",", *[x[f].cast("string") for f in fields]))
    return merge.outcome_entries(s.candidates).withColumn("outcomes", F.array_join(entry, ";"))


def _with_ranges(df: DataFrame) -> DataFrame:
    return df.filter(F.size("ranges") > 0)


def _kept_ranges(s: Steps) -> DataFrame:
    n = F.aggregate("kept", F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"])
    return _with_ranges(s.outliers).withColumn("n_kept", n).withColumn("kept", _joined_text("kept", "start", "end"))


def _kept_weeks(s: Steps) -> DataFrame:
    good = start_dates.week_outliers(s.evidence_lists.filter(F.size("weeks") > 0), "weeks", "good")
    return good.withColumn("good", _joined_text("good", "start"))


def _validated(s: Steps) -> DataFrame:
    known = F.coalesce("extrapolated_preg_start", "min_pregnancy_start", "max_pregnancy_start").isNotNull()
    return s.evidence_rows.filter(known)


def _by_group(step: str, group: str) -> Callable[[Steps], DataFrame]:
    return lambda s: getattr(s, step)(group)


QUERIES: dict[str, Query] = {
    # concept mapping
    "concept_lookup": Query(lambda s: s.found, "lookup", CONCEPT),
    "concept_non_standard": Query(lambda s: concepts.non_standard(s.found), "nonstd", CONCEPT),
    "concept_standard": Query(lambda s: concepts.standard(s.found), "std", CONCEPT),
    "concept_maps_to": Query(lambda s: s.links, "mapsto", LINK),
    "concept_mapped_attributes": Query(
        lambda s: concepts.mapped_attributes(s.links, s.tables.concept), "mapped", CONCEPT),
    "concept_standardize": Query(lambda s: s.standard_codes, "standardized", CONCEPT),
    # prevalence
    "cohort_persons_any_domain": Query(lambda s: s.with_code, "with_code", "person_id"),
    "cohort_cases_demographics": Query(lambda s: prevalence.cases(s.tables.person, s.with_code), "cases", PERSON),
    "cohort_case_events": Query(lambda s: s.case_events, "case_events", AGED),
    "cohort_reproductive_age": Query(lambda s: s.case_women, "case_women", AGED),
    "cohort_controls_demographics": Query(
        lambda s: prevalence.controls(s.tables.person, s.with_code), "controls", PERSON),
    "concept_prevalence_cases": Query(lambda s: s.prevalence, "prevalence", "concept_id concept_name count proportion:f"),
    "concept_frequent": Query(
        lambda s: prevalence.frequent(s.prevalence, s.p), "frequent", "concept_id concept_name count proportion:f"),
    "cohort_control_events": Query(lambda s: s.control_events, "control_events", AGED),
    "concept_prevalence_controls": Query(
        lambda s: prevalence.control_prevalence(s.control_events), "control_prevalence",
        "concept_id concept_name count_controls"),
    "concept_specificity_ratio": Query(
        lambda s: s.specificity, "specificity",
        "concept_id concept_name count proportion:f count_controls proportion_controls:f ratio:f"),
    "concept_highly_specific": Query(
        lambda s: s.specific_concepts, "specific", "concept_id concept_name count ratio:f"),
    "concept_prevalence_by_loads": Query(
        lambda s: s.by_loads.prevalence, "prevalence", "concept_id concept_name count proportion:f"),
    "concept_specificity_by_loads": Query(
        lambda s: s.by_loads.specificity, "specificity",
        "concept_id concept_name count proportion:f count_controls proportion_controls:f ratio:f"),
    # outcomes
    "hip_initial_cohort": Query(lambda s: s.cohort, "cohort", CODED),
    **{
        f"hip_{key}_{group.lower()}": Query(_by_group(step, group), source, columns, f"outcome_group = '{group}'")
        for group in ("SB", "LB", "ECT", "DELIV", "AB")
        for key, step, source, columns in (
            ("visits", "visits", "visits", VISIT), ("gaps", "gaps", "gaps", f"{VISIT} days"),
            ("final", "spaced", "spaced", VISIT),
        )
    },
    **{
        f"hip_add_{group.lower()}": Query(_by_group("admitted", group), f"placed_{group.lower()}", PLACED)
        for group in ("SB", "ECT", "AB", "DELIV")
    },
    "hip_outcome_start_bounds": Query(
        lambda s: s.outcome_timeline, "bounds", f"{PLACED} min_term max_term retry min_start_date:d max_start_date:d"),
    # gestation and reconciliation
    "gest_visits": Query(lambda s: s.gest_visits, "gest_visits", CODED),
    "gest_episodes": Query(
        lambda s: s.gest_episodes, "gest_episodes", f"person_id visit_date:d gest_week week_diff date_diff episode {TRAITS}"),
    "gest_episode_bounds": Query(lambda s: s.gest_bounds, "gest_bounds", RUN),
    "hip_add_gestation": Query(lambda s: s.attached, "attached", f"{JOINED} gest_start_date_diff"),
    "hip_clean_episodes": Query(lambda s: s.cleaned, "cleaned", f"{CLEANED} min_gest_date_diff date_diff_max_end"),
    "hip_remove_overlaps": Query(
        lambda s: s.unlapped, "unlapped", f"{CLEANED} estimated_start_date:d has_overlap is_under_max is_over_min"),
    "hip_episodes": Query(lambda s: reconcile.episode_table(s.unlapped), "hip_table", HIP),
    "hip_episodes_with_length": Query(lambda s: s.hip_episodes, "hip", f"{HIP} gest_date:d episode_length"),
    # timing-specific concepts
    "timing_match_concepts": Query(lambda s: s.matched, "matched", MATCHED),
    "timing_events_in_episode": Query(lambda s: timing.in_episodes(s.matched, s.hip_episodes), "matched_in", IN_EPISODE),
    "timing_domain_concepts": Query(
        lambda s: timing.episode_concepts(s.tables.event, s.specific_concepts, s.hip_episodes, s.p),
        "episode_concepts", IN_EPISODE),
    "timing_gestation_month": Query(
        lambda s: s.timed_months, "months",
        f"{IN_EPISODE} gestation_month:f start_date_of_pregnancy_ft:d gestation_month_ft:f"),
    "timing_stable_concepts": Query(
        lambda s: s.stable_concepts, "stable",
        "domain_concept_id domain_concept_name category percent_episodes:f mean_month:f stddev_of_month:f num_appearances"),
    "timing_concept_summary": Query(
        lambda s: s.concept_summary, "summary",
        "domain_concept_id domain_concept_name mean_gestation_month:f stddev_gestation_month:f distinct_patients"),
    # timing branch
    "pps_match_domain": Query(
        lambda s: pps.match_domains(s.tables.event, s.tables.visit, s.lists.months), "pps_domain", RECORD),
    "pps_input_events": Query(lambda s: s.records, "pps_records", RECORD),
    "pps_month_lookup": Query(lambda s: pps.month_lookup(s.lists.months), "pps_months", "concept_id min_month:f max_month:f"),
    "pps_person_timeline": Query(lambda s: s.line, "pps_line", LINE),
    "pps_agreement": Query(
        lambda s: pps.agreement(cut(s.line), s.lists.months, s.p), "pps_agree", "person_id position event_date:d agrees:b"),
    "pps_episode_split": Query(lambda s: s.split, "pps_split", f"{LINE} starts:b episode"),
    "pps_drop_long_episodes": Query(lambda s: s.short, "pps_short", f"{LINE} episode"),
    "pps_demographic_filter": Query(
        lambda s: cohort.only_women(s.records, s.tables.person, s.p), "pps_women", RECORD),
    "pps_frequency_filter": Query(lambda s: pps.drop_frequent_persons(cut(s.short), s.p), "pps_kept", f"{LINE} episode"),
    "pps_episode_events": Query(lambda s: s.pps_records, "pps_kept", f"{RECORD} min_month:f max_month:f episode"),
    "pps_episodes": Query(lambda s: s.pps_bounds, "pps_bounds", f"{BOUNDS} episode_max_date_plus_two_months:d"),
    # outcomes of the timing branch and merge
    "merge_outcome_concepts": Query(
        lambda s: merge.outcome_concepts(s.lists.outcomes), "outcome_codes", "concept_id concept_name category"),
    "pps_next_episode": Query(
        lambda s: merge.next_episode(s.pps_bounds), "pps_next", f"{BOUNDS} next_closest_episode_date:d"),
    "pps_lookahead_limit": Query(lambda s: s.pps_bounds, "pps_bounds", f"{BOUNDS} max_pregnancy_date:d"),
    "pps_search_window": Query(lambda s: s.windows, "pps_window", f"{BOUNDS} {WINDOW}"),
    "pps_outcome_candidates": Query(
        lambda s: s.candidates, "candidates", f"{BOUNDS} {WINDOW} event_date:d concept_id concept_name category n_records"),
    "pps_outcome_list": Query(_outcome_list, "outcome_list", "person_id person_episode_number outcomes"),
    "pps_first_date_per_category": Query(
        lambda s: s.first_dates, "first_dates", f"person_id person_episode_number {DATES}"),
    "pps_outcomes_per_episode": Query(
        lambda s: merge.pick_outcome(s.first_dates), "picked",
        f"person_id person_episode_number {DATES} pps_category pps_outcome_date:d"),
    "pps_add_outcomes": Query(
        lambda s: s.pps_episodes, "pps", f"{BOUNDS} episode_max_date_plus_two_months:d pps_category pps_outcome_date:d"),
    "merge_overlap_join": Query(lambda s: s.joined, "joined", SIDES),
    "merge_dedupe_overlaps": Query(lambda s: merge.dedupe_overlaps(s.joined), "deduped", f"{SIDES} episode_num"),
    "merge_episode_detail": Query(lambda s: s.merged_episodes, "detail", DETAIL),
    # start dates
    "esd_concept_filter": Query(
        lambda s: s.time_records, "time_records", "person_id record_id domain concept_id concept_name event_date:d"),
    "esd_events_in_episode": Query(lambda s: s.time_in, "time_in", f"{TIMED} recorded_episode_start:d recorded_episode_end:d"),
    "esd_value_normalize": Query(lambda s: s.time_value, "time_value", f"{TIMED} domain_value"),
    "esd_extrapolated_start": Query(lambda s: s.time_start, "time_start", WEEKS),
    "esd_timing_concepts": Query(
        lambda s: start_dates.timing_concepts(
            s.evidence, s.merged_episodes, s.lists.timing, s.lists.ages, s.lists.months, s.p),
        "timed", f"{WEEKS} min_month:f max_month:f"),
    "esd_classify": Query(lambda s: s.classified, "classified", f"{WEEKS} gt_type"),
    "esd_range_bounds": Query(lambda s: s.bounded, "bounded", RANGES),
    "esd_dedupe_evidence": Query(
        lambda s: s.evidence_rows, "evidence",
        f"{EPISODE} rollup_name event_date:d gt_type domain_value concept_id extrapolated_preg_start:d "
        "min_pregnancy_start:d max_pregnancy_start:d"),
    "esd_evidence_list": Query(_lists, "lists", f"{EPISODE} weeks ranges gw_flag gr3m_flag"),
    "esd_date_validate": Query(
        _validated, "evidence", f"{EPISODE} rollup_name event_date:d gt_type concept_id",
        "coalesce(extrapolated_preg_start, min_pregnancy_start, max_pregnancy_start) IS NOT NULL"),
    "esd_range_outliers": Query(_kept_ranges, "gr_shown", f"{EPISODE} overlap_threshold:f n_kept kept"),
    "esd_range_intersection": Query(
        lambda s: _with_ranges(s.intersected).withColumnsRenamed({"core_start": "raw_start", "core_end": "raw_end"}),
        "cores", f"{EPISODE} span_start:d span_end:d raw_start:d raw_end:d"),
    "esd_interval_widen": Query(
        lambda s: _with_ranges(s.widened), "cores",
        f"{EPISODE} core_midpoint:d range_days core_start:d core_end:d"),
    "esd_week_outliers": Query(_kept_weeks, "gw_all_list", f"{EPISODE} good"),
    "esd_start_choice": Query(
        lambda s: s.chosen, "info", f"{EPISODE} {START} intervals_count majority_overlap_count"),
    "esd_precision_category": Query(lambda s: s.timing_info, "info", f"{EPISODE} precision_days precision_category"),
    "esd_infer_start": Query(
        lambda s: start_dates.infer_start(s.evidence_lists, s.p), "info",
        f"{EPISODE} {START} precision_category intervals_count majority_overlap_count"),
    "esd_overlap_stats": Query(
        lambda s: start_dates.overlap_stats(s.timing_info), "overlap_stats",
        "intervals_total majority_total majority_percent:f"),
    "esd_timing_info": Query(
        lambda s: s.timing_info, "info", f"{EPISODE} gw_flag gr3m_flag {START} precision_category"),
    # final table
    "meta_outcome_match": Query(lambda s: s.m_match, "meta_match", f"{EPISODE} outcome_match"),
    "meta_final_outcome": Query(
        lambda s: metadata.final_outcome(s.m_match, s.p), "meta_end", f"{EPISODE} final_outcome_category"),
    "meta_episode_end": Query(lambda s: s.m_end, "meta_end", f"{EPISODE} inferred_episode_end:d"),
    "meta_fill_start_precision": Query(lambda s: s.m_start, "meta_start", f"{EPISODE} {START} precision_category"),
    "meta_term_flag": Query(
        lambda s: s.m_term, "meta_term", f"{EPISODE} gestational_age_days_calculated term_duration_flag"),
    "meta_concordance": Query(
        lambda s: metadata.concordance(s.m_term), "meta_score", f"{EPISODE} outcome_concordance_score"),
    "meta_age": Query(
        lambda s: metadata.age_at_start(s.m_start), "meta_age",
        f"{EPISODE} date_of_birth:d birth_date_diff age_at_inferred_start:f"),
    "meta_race_ethnicity": Query(
        lambda s: metadata.race_and_ethnicity(s.merged_episodes), "meta_race", f"{EPISODE} race ethnicity race_ethnicity"),
    "meta_preterm": Query(
        lambda s: metadata.preterm(s.m_term, s.p), "final", f"{EPISODE} preterm_status_from_calculation"),
    "meta_flag_fill": Query(lambda s: s.m_timing, "meta_timing", f"{EPISODE} gw_flag gr3m_flag"),
    "meta_period_summary": Query(
        lambda s: metadata.period_summary(s.episodes), "period",
        "min_episode_date:d max_episode_date:d min_pregnancy_date:d max_pregnancy_date:d"),
    "episodes_with_metadata": Query(lambda s: s.episodes, "final", FINAL),
}
