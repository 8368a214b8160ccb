"""Thresholds and fixed concept ids."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date


@dataclass(frozen=True)
class Params:
    """Every threshold of the rules. Dates are day-grained throughout."""

    # cohort
    study_start: date = date(2018, 1, 1)  # exclusive
    study_end: date = date(2022, 4, 7)  # inclusive
    birth_year_min: int = 1965
    birth_year_max: int = 2005

    # prevalence and specificity
    min_age: int = 15  # inclusive
    max_age: int = 56  # exclusive
    min_persons: int = 1000  # exclusive
    min_ratio: float = 10.0  # exclusive
    drug_by_record_id: bool = False  # match drug rows on the record id instead of the concept id

    # gestation episodes
    max_week: int = 44
    min_gap_days: int = 70
    buffer_days: int = 28

    # timing-specific concepts
    min_share: float = 3.0
    max_stddev: float = 2.0
    max_stddev_across: float = 1.5
    drop_single_sample: bool = False  # treat an undefined stddev as too large
    full_term_months: int = 9

    # episodes from timing agreement
    month_tolerance: int = 2
    new_episode_months: int = 2
    split_months: int = 10
    max_span_months: int = 12
    max_episodes_per_year: int = 5
    episode_tail_months: int = 2
    lookback_days: int = 14
    lookahead_months: int = 11
    category_by_text: bool = False  # find a category as text anywhere in the outcome entry

    # start dates
    days_per_month: float = 30.4
    min_core_days: int = 7
    core_half_width: int = 3
    majority_percent: int = 50
    max_week_value: int = 44  # exclusive, for gestational-age concepts
    keep_value_markers: bool = False  # leave the text-result markers in observation values

    # final table
    match_window_days: int = 14
    later_outcome_days: int = 7
    preterm_days: int = 259
    open_term_days: int = 301


# Outcome categories, the category without an outcome, and the order in
# which an outcome of the timing branch is picked.
OUTCOMES = ("LB", "SB", "ECT", "AB", "SA", "DELIV")
NO_OUTCOME = "PREG"
OUTCOME_PRIORITY = ("LB", "SB", "ECT", "SA", "AB", "DELIV")


@dataclass(frozen=True)
class FixedConcepts:
    """Public OMOP concept ids the rules name directly."""

    gestational_age: tuple[int, ...] = (3002209, 3048230, 3012266)
    timing_observation: tuple[int, ...] = (
        3011536, 3026070, 3024261, 4260747, 40758410, 3002549, 43054890, 46234792, 4266763,
        40485048, 3048230, 3002209, 3012266,
    )
    timing_measurement: tuple[int, ...] = (3036844, 3048230, 3001105, 3002209, 3050433, 3012266)
    delivery_date: tuple[int, ...] = (
        1175623, 3001105, 3011536, 3024261, 3024973, 3026070, 3036322, 3038318, 3038608, 4059478,
        4128833, 40490322, 40760182, 40760183, 42537958,
    )
    conception_date: tuple[int, ...] = (3002314, 3043737, 4058439, 4072438, 4089559, 44817092)
    gestation_length: tuple[int, ...] = (4260747, 43054890, 46234792, 4266763, 40485048)
    # pregnancy detection evaluation, possible pregnancy, not yet confirmed, history of infertility
    not_timed: tuple[int, ...] = (4250175, 4012558, 45757490, 4058562)
    # current smoker, mother's race, age reported, age, race
    social: tuple[int, ...] = (40766945, 3022828, 3007191, 3022304, 3046853)

    @property
    def timing(self) -> tuple[int, ...]:
        return tuple(sorted({
            *self.timing_observation, *self.timing_measurement, *self.delivery_date,
            *self.conception_date, *self.gestation_length,
        }))

    @property
    def denied(self) -> tuple[int, ...]:
        return self.not_timed + self.social
