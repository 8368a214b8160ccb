"""The whole run: from event tables to episodes with metadata.

Each stage is lazy; ``cut`` writes the few small frames that several later steps read, so
that no step recomputes them and a lost executor repeats one stage only.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storkline.config import Params
from storkline.operators import (
    cohort, concepts, gestation, merge, metadata, outcomes, pps, prevalence, reconcile, start_dates, timing,
)
from storkline.session import cut, cut_by, small_tasks
from storkline.sources.omop import Lists, Tables


class Pipeline:
    """Stages as properties; each is built once and computed when first needed.

    ``first_records`` may hold the first records of all loads of events (`operators.loads`); concept
    statistics then come from them instead of the event table.
    """

    def __init__(self, tables: Tables, lists: Lists, params: Params | None = None, first_records: DataFrame | None = None):
        self.tables, self.lists, self.p = tables, lists, params or Params()
        if first_records is not None and self.p.drug_by_record_id:
            raise ValueError("first records of loads keep no record ids to match drugs on")
        self._first_records = first_records

    # -- code lists ----------------------------------------------------------------------

    @cached_property
    def standard_codes(self) -> DataFrame:
        """The initial code list as standard concepts."""
        return concepts.standardize(self.lists.initial, self.tables.concept, self.tables.concept_relationship)

    @cached_property
    def person_concepts(self) -> DataFrame:
        """The one pass over all events for the statistics: each person's concepts, bucketed by person, as cases and
        controls are both joined by person."""
        if self._first_records is not None:
            found = prevalence.earliest(self._first_records)
        else:
            found = prevalence.person_concepts(self.tables.event)
        spark = found.sparkSession
        with small_tasks(spark):
            return cut_by(found, "person_id", int(spark.conf.get("spark.sql.shuffle.partitions")))

    @cached_property
    def coded_persons(self) -> DataFrame:
        """Persons with a code of the standardized list."""
        if self.p.drug_by_record_id:
            return cut(prevalence.persons_with_code(self.tables.event, self.standard_codes, self.p))
        # written, the list has a known size, by which Spark may broadcast it
        return cut(prevalence.coded_persons(self.person_concepts, cut(self.standard_codes)))

    @cached_property
    def case_events(self) -> DataFrame:
        cases = prevalence.cases(self.tables.person, self.coded_persons)
        return prevalence.concept_ages(self.person_concepts, cases)

    @cached_property
    def case_women(self) -> DataFrame:
        return prevalence.reproductive_age(self.case_events, self.p)

    @cached_property
    def control_events(self) -> DataFrame:
        controls = prevalence.controls(self.tables.person, self.coded_persons)
        return prevalence.concept_ages(self.person_concepts, controls)

    @cached_property
    def prevalence(self) -> DataFrame:
        return prevalence.case_prevalence(self.case_women)

    @cached_property
    def specificity(self) -> DataFrame:
        common = prevalence.frequent(self.prevalence, self.p)
        return prevalence.specificity(common, prevalence.control_prevalence(self.control_events))

    @cached_property
    def specific_concepts(self) -> DataFrame:
        """Concepts far more common in persons with a code of the standardized list than in others."""
        return prevalence.highly_specific(self.specificity, self.p)

    # -- episodes ------------------------------------------------------------------------

    @cached_property
    def evidence(self) -> DataFrame:
        """The one pass over the full event table: rows that any later stage can use."""
        ids = (
            self.lists.outcomes.select("concept_id")
            .unionByName(self.lists.months.select(F.col("domain_concept_id").alias("concept_id")))
            .unionByName(self.lists.timing.select("concept_id"))
            .distinct()
        )
        listed = ids.withColumn("_listed", F.lit(True))
        return cut(
            self.tables.event.filter(F.col("domain") != "drug")
            .join(listed, "concept_id", "left")
            .filter(F.col("_listed") | F.lower("concept_name").contains(start_dates.WEEK_NAME))
            .drop("_listed")
        )

    @cached_property
    def _coded(self) -> DataFrame:
        return cohort.coded_events(self.evidence, self.lists.outcomes, self.p)

    @cached_property
    def outcome_timeline(self) -> DataFrame:
        """Spaced outcomes of all groups, admitted to one timeline, with start bounds."""
        visits = cohort.with_women(outcomes.outcome_visits(self._coded), self.tables.person, self.p)
        spaced = outcomes.spaced_visits(outcomes.visit_gaps(visits), self.lists.limits)
        return outcomes.start_bounds(outcomes.admit_through(spaced, self.lists.limits), self.lists.terms)

    @cached_property
    def gestation_days(self) -> DataFrame:
        days = gestation.gestation_days(gestation.gestation_visits(self._coded, self.lists.ages), self.p)
        return cut(cohort.with_women(days, self.tables.person, self.p))

    @cached_property
    def hip_episodes(self) -> DataFrame:
        """Episodes of the outcome and gestation branches, with their length."""
        runs = gestation.gestation_bounds(gestation.gestation_episodes(self.gestation_days, self.p))
        joined = reconcile.attach_gestation(self.outcome_timeline, runs, self.p)
        cleaned = reconcile.remove_overlaps(reconcile.clean_episodes(joined, self.p))
        return cut(reconcile.episode_lengths(reconcile.episode_table(cleaned), self.gestation_days))

    @cached_property
    def pps_records(self) -> DataFrame:
        """Records of the timing branch with their episode number."""
        p, months = self.p, self.lists.months
        records = pps.timed_records(self.evidence, self.tables.visit, months, p)
        ordered = cut(pps.timeline(records, months, self.tables.person, p))
        kept = cut(pps.drop_long_episodes(pps.split_episodes(ordered, months, p), p))
        return pps.drop_frequent_persons(kept, p)

    @cached_property
    def pps_bounds(self) -> DataFrame:
        return cut(pps.episode_bounds(self.pps_records, self.p))

    @cached_property
    def pps_episodes(self) -> DataFrame:
        """Episodes of the timing branch with their outcome."""
        windows = merge.search_windows(self.pps_bounds, self.p)
        found = merge.outcome_candidates(self.evidence, self.lists.outcomes, windows)
        picked = merge.pick_outcome(merge.first_dates(found, self.p))
        return merge.add_outcomes(self.pps_bounds, picked)

    @cached_property
    def merged_episodes(self) -> DataFrame:
        """Both branches merged, with demographics."""
        pairs = merge.overlap_join(self.hip_episodes, self.pps_episodes)
        return cut(merge.episode_detail(merge.dedupe_overlaps(pairs), self.tables.person))

    @cached_property
    def timing_info(self) -> DataFrame:
        """Inferred start of each merged episode that has timing evidence. Written out, so that
        filters on its columns are not pushed into, and repeated within, the array expressions."""
        return cut(start_dates.timing_info(
            self.evidence, self.merged_episodes, self.lists.timing, self.lists.ages, self.lists.months, self.p
        ))

    @cached_property
    def episodes(self) -> DataFrame:
        """The final table."""
        return metadata.with_metadata(self.merged_episodes, self.timing_info, self.lists.terms, self.p)

    # -- concepts with stable timing -----------------------------------------------------

    @cached_property
    def timed_months(self) -> DataFrame:
        found = timing.episode_concepts(
            self.tables.event, self.specific_concepts, self.hip_episodes, self.p
        )
        return cut(timing.gestation_months(found, self.p))

    @cached_property
    def stable_concepts(self) -> DataFrame:
        return timing.stable_concepts(self.timed_months, self.lists.denied, self.p)

    @cached_property
    def concept_summary(self) -> DataFrame:
        return timing.concept_summary(self.stable_concepts, self.timed_months)
