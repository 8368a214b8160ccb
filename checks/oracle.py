"""DuckDB SQL for every step, as named common table expressions over the base tables.

Written from the rules, in relational form, apart from the Spark operators: self joins and
set operations here stand against windows, single-pass frames and array expressions there.
"""

from __future__ import annotations

import re

from checks.fixture import BASE, PARAMS, VIEWS

P = PARAMS
CTES: dict[str, str] = {name: text.format(**{b: b for b in BASE}) for name, text in VIEWS.items()}
OUTCOMES = "('LB','SB','ECT','AB','SA','DELIV')"
GROUP = "CASE WHEN category IN ('AB','SA') THEN 'AB' ELSE category END"


def cte(name: str, text: str) -> None:
    CTES[name] = text


# -- concept mapping ---------------------------------------------------------------------
cte("lookup", "SELECT c.*, h.category FROM f_initial h JOIN f_concept c ON c.concept_id = h.concept_id")
cte("nonstd", "SELECT * FROM lookup WHERE standard_concept IS NULL")
cte("std", "SELECT * FROM lookup WHERE standard_concept = 'S'")
cte("mapsto", """SELECT n.*, r.concept_id_1, r.concept_id_2, r.relationship_id FROM nonstd n
 JOIN f_concept_relationship r ON n.concept_id = r.concept_id_1 WHERE r.relationship_id = 'Maps to'""")
cte("mapped", "SELECT c.*, m.category FROM mapsto m JOIN f_concept c ON c.concept_id = m.concept_id_2")
cte("standardized", "SELECT * FROM std UNION ALL SELECT * FROM mapped")

# -- prevalence --------------------------------------------------------------------------
cte("with_code", "SELECT DISTINCT person_id FROM f_event WHERE concept_id IN (SELECT concept_id FROM standardized)")
BORN = """try_cast(year_of_birth || '-' || month_of_birth || '-' || coalesce(day_of_birth, 1) AS DATE)"""
cte("cases", f"SELECT person_id, gender_concept_name, {BORN} AS date_of_birth FROM f_person "
    "WHERE person_id IN (SELECT person_id FROM with_code)")
cte("controls", f"SELECT person_id, gender_concept_name, {BORN} AS date_of_birth FROM f_person "
    "WHERE person_id NOT IN (SELECT person_id FROM with_code)")
cte("person_concepts", """SELECT DISTINCT ON (person_id, concept_id) person_id, concept_id, concept_name,
 event_date AS visit_date, domain FROM f_event ORDER BY person_id, concept_id, event_date, domain, record_id""")
for side in ("case", "control"):
    cte(f"{side}_events", f"""SELECT e.*, p.gender_concept_name, p.date_of_birth,
 CAST(visit_date - date_of_birth AS INT) AS date_diff, (visit_date - date_of_birth) / 365 AS age
 FROM person_concepts e JOIN {side}s p USING (person_id)""")
cte("case_women", f"""SELECT * FROM case_events
 WHERE gender_concept_name = 'FEMALE' AND age >= {P.min_age} AND age < {P.max_age}""")
cte("prevalence", """SELECT concept_id, concept_name, count(DISTINCT person_id) AS count,
 count(DISTINCT person_id) / (SELECT count(DISTINCT person_id) FROM case_women) AS proportion
 FROM case_women WHERE concept_id <> 0 AND concept_name IS NOT NULL GROUP BY ALL""")
cte("frequent", f"SELECT * FROM prevalence WHERE count > {P.min_persons}")
cte("control_prevalence", """SELECT concept_id, concept_name, count(DISTINCT person_id) AS count_controls
 FROM control_events GROUP BY ALL""")
cte("specificity", """SELECT *, proportion / nullif(proportion_controls, 0) AS ratio FROM (
 SELECT f.*, coalesce(c.count_controls, 1) AS count_controls, coalesce(c.count_controls, 1)
  / nullif((SELECT count(DISTINCT person_id) FROM control_events), 0) AS proportion_controls
 FROM frequent f LEFT JOIN control_prevalence c ON c.concept_id = f.concept_id)""")
cte("specific", f"SELECT * FROM specificity WHERE ratio > {P.min_ratio}")

# -- cohort and outcomes -----------------------------------------------------------------
cte("women", f"""SELECT DISTINCT person_id, year_of_birth, race_concept_name, ethnicity_concept_name FROM f_person
 WHERE gender_concept_name = 'FEMALE' AND year_of_birth >= {P.birth_year_min} AND year_of_birth <= {P.birth_year_max}""")
cte("cohort", f"""SELECT DISTINCT e.person_id, e.concept_id, e.concept_name, e.data_partner_id,
 e.event_date AS visit_date, h.category, h.gest_value,
 CASE WHEN e.domain IN ('observation', 'measurement') THEN e.value_as_number END AS value_as_number,
 w.year_of_birth, w.race_concept_name, w.ethnicity_concept_name
 FROM f_event e JOIN f_hip h ON h.concept_id = e.concept_id JOIN women w ON w.person_id = e.person_id
 WHERE e.domain <> 'drug' AND e.event_date > DATE '{P.study_start}' AND e.event_date <= DATE '{P.study_end}'""")
cte("visits", f"""SELECT DISTINCT ON (person_id, outcome_group, visit_date) * FROM (
 SELECT *, {GROUP} AS outcome_group FROM cohort WHERE category IN {OUTCOMES})
 ORDER BY person_id, outcome_group, visit_date, category, concept_id, concept_name, data_partner_id,
 gest_value NULLS FIRST, value_as_number NULLS FIRST""")
cte("gaps", """SELECT v.*, CAST(visit_date - (SELECT max(b.visit_date) FROM visits b WHERE b.person_id = v.person_id
 AND b.outcome_group = v.outcome_group AND b.visit_date < v.visit_date) AS INT) AS days FROM visits v""")
cte("spaced", """SELECT g.* FROM gaps g JOIN f_limits l
 ON l.first_preg_category = g.outcome_group AND l.outcome_preg_category = g.outcome_group
 WHERE g.days IS NULL OR g.days >= l.min_days""")

SLIM = ("person_id, concept_id, concept_name, data_partner_id, visit_date, category, year_of_birth, "
        "race_concept_name, ethnicity_concept_name, outcome_group")
cte("placed_lb", f"SELECT {SLIM} FROM spaced WHERE outcome_group = 'LB'")


def limit(first: str, second: str) -> str:
    return (f"(SELECT min_days FROM f_limits WHERE first_preg_category = {first} "
            f"AND outcome_preg_category = {second})")


def admission(name: str, before: str, group: str) -> None:
    """All kept cases of a candidate, one by one, by what lies before and after it."""
    need_prev = (f"CASE WHEN pg IN ('LB','SB') THEN {limit(chr(39) + 'LB' + chr(39), chr(39) + group + chr(39))} "
                 f"ELSE {limit(chr(39) + 'ECT' + chr(39), chr(39) + group + chr(39))} END")
    q = chr(39)
    need_next = (f"CASE ng WHEN 'LB' THEN {limit(q + group + q, q + 'LB' + q)} "
                 f"WHEN 'SB' THEN {limit(q + group + q, q + 'SB' + q)} ELSE {limit(q + group + q, q + 'ECT' + q)} END")
    cte(name, f"""SELECT * FROM {before} UNION ALL SELECT {SLIM} FROM (
 SELECT *, lag(outcome_group) OVER w AS pg, visit_date - lag(visit_date) OVER w AS pd,
  lead(outcome_group) OVER w AS ng, lead(visit_date) OVER w - visit_date AS nd
 FROM (SELECT * FROM {before} UNION ALL SELECT {SLIM} FROM spaced WHERE outcome_group = '{group}')
 WINDOW w AS (PARTITION BY person_id ORDER BY visit_date, outcome_group, concept_id))
 WHERE outcome_group = '{group}' AND (
  (pg IS NULL AND ng IS NULL)
  OR (pg = '{group}' AND (ng IS NULL OR ng = '{group}')) OR (pg IS NULL AND ng = '{group}')
  OR (pg <> '{group}' AND pd >= {need_prev} AND ng IS NULL)
  OR (pg IS NULL AND ng <> '{group}' AND nd >= {need_next})
  OR (pg <> '{group}' AND pd >= {need_prev} AND ng <> '{group}' AND nd >= {need_next}))""")


admission("placed_sb", "placed_lb", "SB")
admission("placed_ect", "placed_sb", "ECT")
admission("placed_ab", "placed_ect", "AB")
admission("placed_deliv", "placed_ab", "DELIV")
cte("bounds", """SELECT p.*, t.min_term, t.max_term, t.retry, p.visit_date - t.min_term AS min_start_date,
 p.visit_date - t.max_term AS max_start_date FROM placed_deliv p LEFT JOIN f_terms t ON t.category = p.category""")

# -- gestation ---------------------------------------------------------------------------
cte("gest_visits", """SELECT * FROM cohort WHERE gest_value IS NOT NULL
 UNION ALL SELECT * REPLACE (CAST(trunc(value_as_number) AS INT) AS gest_value) FROM cohort
 WHERE concept_id IN (SELECT concept_id FROM f_ages) AND value_as_number IS NOT NULL""")
cte("gest_days", f"""SELECT person_id, visit_date, max(gest_value) AS gest_week,
 min(data_partner_id) AS data_partner_id, any_value(year_of_birth) AS year_of_birth,
 any_value(race_concept_name) AS race_concept_name, any_value(ethnicity_concept_name) AS ethnicity_concept_name
 FROM gest_visits WHERE gest_value > 0 AND gest_value <= {P.max_week} GROUP BY person_id, visit_date""")
cte("gest_episodes", f"""SELECT *, CAST(sum(CASE WHEN week_diff IS NULL
 OR (week_diff <= 0 AND date_diff >= {P.min_gap_days})
 OR (week_diff > 0 AND date_diff >= 7 * week_diff + {P.buffer_days}) THEN 1 ELSE 0 END)
 OVER (PARTITION BY person_id ORDER BY visit_date) AS BIGINT) AS episode FROM (
 SELECT *, gest_week - lag(gest_week) OVER w AS week_diff,
  CAST(visit_date - lag(visit_date) OVER w AS INT) AS date_diff
 FROM gest_days WINDOW w AS (PARTITION BY person_id ORDER BY visit_date))""")
cte("gest_bounds", """SELECT b.*, f.gest_week AS first_gest_week, f.data_partner_id, l.gest_week AS end_gest_week,
 (SELECT min(visit_date) FROM gest_episodes e WHERE e.person_id = b.person_id AND e.episode = b.episode
  AND e.gest_week = b.min_gest_week) AS min_gest_date,
 (SELECT max(visit_date) FROM gest_episodes e WHERE e.person_id = b.person_id AND e.episode = b.episode
  AND e.gest_week = b.min_gest_week) AS min_gest_date_2,
 (SELECT min(visit_date) FROM gest_episodes e WHERE e.person_id = b.person_id AND e.episode = b.episode
  AND e.gest_week = b.max_gest_week) AS max_gest_date
 FROM (SELECT person_id, episode, any_value(year_of_birth) AS year_of_birth,
  any_value(race_concept_name) AS race_concept_name, any_value(ethnicity_concept_name) AS ethnicity_concept_name,
  min(visit_date) AS first_gest_date, max(visit_date) AS end_gest_date, min(gest_week) AS min_gest_week,
  max(gest_week) AS max_gest_week FROM gest_episodes GROUP BY person_id, episode) b
 JOIN gest_episodes f ON f.person_id = b.person_id AND f.visit_date = b.first_gest_date
 JOIN gest_episodes l ON l.person_id = b.person_id AND l.visit_date = b.end_gest_date""")

# -- outcomes and gestation reconciled -----------------------------------------------------
B = P.buffer_days
cte("gest_runs", """SELECT *, max_gest_date - 7 * max_gest_week AS max_gest_start_date,
 min_gest_date - 7 * min_gest_week AS min_gest_start_date FROM gest_bounds""")
cte("pairs", f"""SELECT o.person_id, o.visit_date AS outcome_date, g.max_gest_date FROM bounds o
 JOIN gest_runs g ON g.person_id = o.person_id WHERE
 (g.max_gest_start_date >= o.max_start_date - {B} AND g.max_gest_date <= o.visit_date + {B})
 OR (g.max_gest_start_date >= o.max_start_date - {B} AND g.max_gest_start_date <= o.visit_date
  AND g.max_gest_date >= o.visit_date + {B})
 OR (g.max_gest_start_date <= o.max_start_date - {B} AND g.max_gest_date <= o.visit_date + {B}
  AND g.max_gest_date >= o.max_start_date)
 OR (g.max_gest_start_date <= o.max_start_date AND g.max_gest_date >= o.visit_date)""")
cte("links", """SELECT * FROM pairs
 UNION ALL SELECT person_id, visit_date, NULL FROM bounds o WHERE NOT EXISTS (
  SELECT 1 FROM pairs p WHERE p.person_id = o.person_id AND p.outcome_date = o.visit_date)
 UNION ALL SELECT person_id, NULL, max_gest_date FROM gest_runs g WHERE NOT EXISTS (
  SELECT 1 FROM pairs p WHERE p.person_id = g.person_id AND p.max_gest_date = g.max_gest_date)""")
NUMBER = ("row_number() OVER (PARTITION BY person_id ORDER BY visit_date NULLS FIRST, category NULLS FIRST, "
          "max_gest_date NULLS FIRST, outcome_date NULLS FIRST)")
cte("attached", f"""SELECT *, CAST({NUMBER} AS INT) AS episode FROM (
 SELECT k.person_id, coalesce(o.category, 'PREG') AS category, coalesce(k.outcome_date, k.max_gest_date) AS visit_date,
 k.outcome_date, o.concept_id, o.concept_name, o.min_term, o.max_term, o.retry, o.min_start_date, o.max_start_date,
 g.first_gest_date, g.first_gest_week, g.end_gest_date, g.end_gest_week, g.min_gest_week, g.min_gest_date,
 g.min_gest_date_2, g.max_gest_week, k.max_gest_date, g.max_gest_start_date,
 CAST(g.max_gest_start_date - g.min_gest_start_date AS INT) AS gest_start_date_diff,
 CAST(k.outcome_date - k.max_gest_date AS INT) AS days_diff,
 coalesce(o.data_partner_id, g.data_partner_id) AS data_partner_id,
 w.year_of_birth, w.race_concept_name, w.ethnicity_concept_name
 FROM links k LEFT JOIN bounds o ON o.person_id = k.person_id AND o.visit_date = k.outcome_date
 LEFT JOIN gest_runs g ON g.person_id = k.person_id AND g.max_gest_date = k.max_gest_date
 JOIN women w ON w.person_id = k.person_id)""")
cte("near_gest", """SELECT a.* FROM attached a WHERE max_gest_date IS NULL OR days_diff IS NULL OR NOT EXISTS (
 SELECT 1 FROM attached b WHERE b.person_id = a.person_id AND b.max_gest_date = a.max_gest_date
 AND abs(b.days_diff) < abs(a.days_diff))""")
cte("near_both", """SELECT a.* FROM near_gest a WHERE outcome_date IS NULL OR days_diff IS NULL OR NOT EXISTS (
 SELECT 1 FROM near_gest b WHERE b.person_id = a.person_id AND b.outcome_date = a.outcome_date
 AND abs(b.days_diff) < abs(a.days_diff))""")
CLEARED = ("concept_id", "concept_name", "min_term", "max_term", "retry", "min_start_date", "max_start_date",
           "days_diff", "outcome_date")


def without_outcome(source: str, condition: str, drop: str = "bad") -> str:
    cleared = ", ".join(f"CASE WHEN NOT {drop} THEN {c} END AS {c}" for c in CLEARED)
    return f"""SELECT * EXCLUDE ({drop}) REPLACE ({cleared},
 CASE WHEN {drop} THEN max_gest_date ELSE visit_date END AS visit_date,
 CASE WHEN {drop} THEN 'PREG' ELSE category END AS category,
 CASE WHEN {drop} THEN category ELSE removed_category END AS removed_category,
 CASE WHEN {drop} THEN 1 ELSE removed_outcome END AS removed_outcome)
 FROM (SELECT *, coalesce({condition}, false) AS {drop} FROM {source})"""


cte("unfit", "SELECT * EXCLUDE (episode), CAST(NULL AS VARCHAR) AS removed_category, 0 AS removed_outcome FROM near_both")
cte("fit", without_outcome("unfit", f"""max_gest_date IS NOT NULL AND outcome_date IS NOT NULL AND (
 max_term IS NULL OR visit_date - max_gest_start_date > max_term OR days_diff < -{B})"""))
cte("cleaned", f"""SELECT *, CAST({NUMBER} AS INT) AS episode,
 CAST(visit_date - max_gest_start_date AS INT) AS gest_at_outcome,
 CAST(min_gest_date_2 - min_gest_date AS INT) AS min_gest_date_diff,
 CAST(max_gest_date - end_gest_date AS INT) AS date_diff_max_end FROM fit""")
cte("lapped", """SELECT c.* EXCLUDE (gest_at_outcome), p.visit_date AS prev_date, p.category AS prev_category,
 p.retry AS prev_retry, p.max_gest_date AS prev_gest,
 CASE WHEN coalesce(c.max_gest_start_date, c.max_start_date) < p.visit_date THEN 1 ELSE 0 END AS has_overlap
 FROM cleaned c LEFT JOIN cleaned p ON p.person_id = c.person_id AND p.episode = c.episode - 1""")
cte("undropped", """SELECT * FROM lapped a WHERE NOT (category = 'PREG' AND EXISTS (SELECT 1 FROM lapped n
 WHERE n.person_id = a.person_id AND n.has_overlap = 1 AND n.prev_category = 'PREG' AND n.prev_gest = a.max_gest_date))""")
cte("restarted", f"""SELECT *,
 CAST(visit_date - estimated_start_date AS INT) AS gest_at_outcome,
 CASE WHEN visit_date - estimated_start_date <= max_term THEN 1 ELSE 0 END AS is_under_max,
 CASE WHEN visit_date - estimated_start_date >= min_term THEN 1 ELSE 0 END AS is_over_min,
 CAST({NUMBER} AS INT) AS episode FROM (
 SELECT * EXCLUDE (episode), CASE WHEN has_overlap = 1 AND prev_retry IS NOT NULL THEN prev_date + prev_retry
 ELSE coalesce(max_gest_start_date, max_start_date) END AS estimated_start_date FROM undropped)""")
cte("unlapped", without_outcome(
    "restarted", "max_gest_week IS NOT NULL AND concept_name IS NOT NULL AND is_over_min = 0"))
cte("hip_table", """SELECT DISTINCT person_id, category, visit_date, estimated_start_date, episode, data_partner_id,
 year_of_birth, race_concept_name, ethnicity_concept_name FROM unlapped""")
cte("hip", """SELECT h.*, g.gest_date, CASE WHEN h.visit_date - g.gest_date > 0
 THEN CAST(h.visit_date - g.gest_date AS INT) ELSE 1 END AS episode_length FROM hip_table h LEFT JOIN (
 SELECT e.person_id, e.episode, min(v.visit_date) AS gest_date FROM hip_table e JOIN gest_visits v
 ON v.person_id = e.person_id AND v.visit_date BETWEEN e.estimated_start_date AND e.visit_date GROUP BY ALL) g
 ON g.person_id = h.person_id AND g.episode = h.episode""")

# -- timing-specific concepts ----------------------------------------------------------------
cte("matched", """SELECT person_id, domain, concept_id AS domain_concept_id, concept_name AS domain_concept_name,
 event_date AS domain_concept_start_date, count(*) AS n_records FROM f_event
 WHERE concept_id IN (SELECT concept_id FROM specific) GROUP BY ALL""")
SPAN = """SELECT m.*, h.episode, h.estimated_start_date AS start_date_of_pregnancy, h.visit_date AS end_date,
 h.category FROM matched m JOIN hip h ON h.person_id = m.person_id
 AND m.domain_concept_start_date > h.estimated_start_date AND m.domain_concept_start_date < h.visit_date"""
cte("matched_in", SPAN)
cte("episode_concepts", "SELECT * FROM matched_in WHERE category NOT IN ('PREG', 'DELIV')")
cte("months", f"""SELECT *, CAST(domain_concept_start_date - start_date_of_pregnancy AS INT) AS days,
 (domain_concept_start_date - start_date_of_pregnancy) / 30 AS gestation_month,
 CASE WHEN category = 'LB' THEN CAST(end_date - INTERVAL {P.full_term_months} MONTH AS DATE) END
  AS start_date_of_pregnancy_ft,
 CASE WHEN category = 'LB' THEN (domain_concept_start_date - CAST(end_date - INTERVAL {P.full_term_months} MONTH AS DATE))
  / 30 END AS gestation_month_ft FROM episode_concepts""")
cte("month_rows", """SELECT * FROM months, range(n_records)""")
cte("month_stats", """SELECT v.domain_concept_id, v.domain_concept_name, v.view AS category, s.percent_episodes,
 avg(month) AS mean_month, stddev_samp(month) AS stddev_of_month, CAST(count(month) AS INT) AS num_appearances FROM (
 SELECT domain_concept_id, domain_concept_name, category, category AS view, gestation_month AS month FROM month_rows
 UNION ALL SELECT domain_concept_id, domain_concept_name, category, 'LB_FT', gestation_month_ft FROM month_rows
 WHERE gestation_month_ft IS NOT NULL) v JOIN (
 SELECT domain_concept_id, domain_concept_name, category, 100.0 * count(DISTINCT (person_id, episode))
  / any_value(total) AS percent_episodes FROM months JOIN (SELECT category, count(DISTINCT (person_id, episode)) AS total
  FROM months GROUP BY category) USING (category) GROUP BY ALL) s
 USING (domain_concept_id, domain_concept_name, category) GROUP BY ALL""")
cte("stable", f"""WITH often AS (SELECT * FROM month_stats WHERE percent_episodes > {P.min_share}),
 steady AS (SELECT * FROM often WHERE domain_concept_id NOT IN (
  SELECT domain_concept_id FROM often WHERE stddev_of_month > {P.max_stddev}))
 SELECT * FROM steady WHERE domain_concept_id NOT IN (SELECT domain_concept_id FROM (
  SELECT domain_concept_id, domain_concept_name, stddev_samp(mean_month) AS sd FROM steady GROUP BY ALL)
  WHERE sd > {P.max_stddev_across})
 AND domain_concept_id NOT IN (SELECT concept_id FROM f_denied)""")
cte("summary", """SELECT m.domain_concept_id, m.domain_concept_name, avg(gestation_month) AS mean_gestation_month,
 stddev_samp(gestation_month) AS stddev_gestation_month, count(DISTINCT person_id) AS distinct_patients
 FROM month_rows m JOIN (SELECT DISTINCT domain_concept_id, domain_concept_name FROM stable)
 USING (domain_concept_id, domain_concept_name) GROUP BY ALL""")

# -- timing branch ---------------------------------------------------------------------------
cte("pps_domain", """SELECT * FROM (SELECT DISTINCT person_id, event_date, concept_id, concept_name, domain FROM f_event
 WHERE domain IN ('condition', 'procedure', 'observation', 'measurement') UNION SELECT person_id, visit_start_date,
 visit_concept_id, visit_concept_name, 'visit' FROM f_visit) WHERE concept_id IN (SELECT domain_concept_id FROM f_pps)""")
cte("pps_records", f"""SELECT * FROM (SELECT DISTINCT person_id, event_date, concept_id, concept_name, domain FROM f_event
 WHERE domain <> 'drug' UNION SELECT person_id, visit_start_date, visit_concept_id, visit_concept_name, 'visit'
 FROM f_visit) WHERE concept_id IN (SELECT domain_concept_id FROM f_pps)
 AND event_date > DATE '{P.study_start}' AND event_date <= DATE '{P.study_end}'""")
cte("pps_months", """SELECT DISTINCT ON (concept_id) domain_concept_id AS concept_id, min_month, max_month FROM f_pps
 ORDER BY concept_id, max_month DESC, min_month DESC""")
cte("pps_line", """SELECT r.*, m.min_month, m.max_month,
 CAST(row_number() OVER w AS INT) AS position, CAST(event_date - lag(event_date) OVER w AS INT) AS gap_days,
 count(*) OVER (PARTITION BY r.person_id) AS records
 FROM pps_records r JOIN pps_months m USING (concept_id) JOIN women USING (person_id)
 WINDOW w AS (PARTITION BY r.person_id ORDER BY event_date, concept_id, concept_name, domain)""")


def fits(later: str, earlier: str) -> str:
    months = f"({later}.event_date - {earlier}.event_date) / 30"
    return (f"({later}.max_month - {earlier}.min_month + {P.month_tolerance} >= {months} "
            f"AND {months} >= {later}.min_month - {earlier}.max_month - {P.month_tolerance})")


cte("pps_agree", f"""SELECT a.person_id, a.position, a.event_date,
 EXISTS (SELECT 1 FROM pps_line e WHERE e.person_id = a.person_id AND e.position < a.position AND {fits('a', 'e')})
 OR EXISTS (SELECT 1 FROM pps_line e JOIN pps_line l ON l.person_id = e.person_id
  WHERE e.person_id = a.person_id AND e.position < a.position AND e.position + l.position = 2 * a.position
  AND {fits('l', 'e')}) AS agrees
 FROM pps_line a""")
cte("pps_split", f"""SELECT *, CAST(1 + sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (
 PARTITION BY person_id ORDER BY position) AS INT) AS episode FROM (
 SELECT l.*, coalesce(gap_days / 30 > {P.split_months}, false)
 OR coalesce(gap_days / 30 > {P.new_episode_months} AND NOT agrees, false) AS starts
 FROM pps_line l LEFT JOIN pps_agree a USING (person_id, position))""")
cte("pps_short", f"""SELECT s.* REPLACE (CAST(dense_rank() OVER (PARTITION BY person_id ORDER BY episode) AS INT) AS episode)
 FROM pps_split s JOIN (SELECT person_id, episode FROM pps_split GROUP BY ALL
 HAVING (max(event_date) - min(event_date)) / 30 <= {P.max_span_months}) USING (person_id, episode)""")
cte("pps_women", """SELECT r.* FROM pps_records r JOIN women USING (person_id)""")
cte("pps_kept", f"""SELECT * FROM pps_short WHERE person_id IN (SELECT person_id FROM pps_short GROUP BY person_id
 HAVING max(episode) / nullif((SELECT (max(event_date) - min(event_date)) / 365 FROM pps_short), 0)
 < {P.max_episodes_per_year})""")
cte("pps_bounds", f"""SELECT b.*, CAST(episode_max_date + INTERVAL {P.episode_tail_months} MONTH AS DATE)
 AS episode_max_date_plus_two_months,
 CAST(episode_max_date + to_months(CAST(trunc({P.lookahead_months} - low) AS INT)) AS DATE) AS max_pregnancy_date
 FROM (SELECT person_id, episode AS person_episode_number, min(event_date) AS episode_min_date,
 max(event_date) AS episode_max_date, first(min_month ORDER BY event_date DESC, max_month DESC, min_month) AS low
 FROM pps_kept GROUP BY ALL) b""")
cte("pps_next", """SELECT b.*, coalesce((SELECT n.episode_min_date - 1 FROM pps_bounds n
 WHERE n.person_id = b.person_id AND n.person_episode_number = b.person_episode_number + 1), DATE '2999-01-01')
 AS next_closest_episode_date FROM pps_bounds b""")
cte("pps_window", f"""SELECT *, episode_max_date - {P.lookback_days} AS lookback_date,
 least(next_closest_episode_date, max_pregnancy_date) AS lookahead_date FROM pps_next""")
cte("outcome_codes", f"SELECT DISTINCT concept_id, concept_name, category FROM f_hip WHERE category IN {OUTCOMES}")
cte("candidates", """SELECT w.person_id, w.person_episode_number, w.episode_min_date, w.episode_max_date,
 w.lookback_date, w.lookahead_date, e.event_date, e.concept_id, e.concept_name, c.category, count(*) AS n_records
 FROM f_event e JOIN pps_window w ON w.person_id = e.person_id AND e.event_date BETWEEN w.lookback_date AND w.lookahead_date
 JOIN (SELECT DISTINCT concept_id, category FROM outcome_codes) c ON c.concept_id = e.concept_id
 WHERE e.domain <> 'drug' GROUP BY ALL""")
cte("outcome_list", """SELECT person_id, person_episode_number, string_agg(strftime(event_date, '%Y-%m-%d') || ',' || concept_id
 || ',' || concept_name || ',' || category || ',' || n_records, ';' ORDER BY event_date, concept_id, concept_name, category)
 AS outcomes FROM candidates GROUP BY ALL""")
cte("first_dates", "SELECT person_id, person_episode_number, episode_min_date, " + ", ".join(
    f"min(event_date) FILTER (category = '{c}') AS {c}_date" for c in ("LB", "SB", "ECT", "AB", "SA", "DELIV"))
    + " FROM candidates GROUP BY ALL")
cte("picked", """SELECT *, CASE WHEN LB_date IS NOT NULL THEN 'LB' WHEN SB_date IS NOT NULL THEN 'SB'
 WHEN ECT_date IS NOT NULL THEN 'ECT' WHEN SA_date IS NOT NULL THEN 'SA' WHEN AB_date IS NOT NULL THEN 'AB'
 WHEN DELIV_date IS NOT NULL THEN 'DELIV' END AS pps_category,
 coalesce(LB_date, SB_date, ECT_date, SA_date, AB_date, DELIV_date) AS pps_outcome_date FROM first_dates""")
cte("pps", """SELECT b.person_id, b.person_episode_number, b.episode_min_date, b.episode_max_date,
 b.episode_max_date_plus_two_months, p.pps_category, p.pps_outcome_date FROM pps_bounds b
 LEFT JOIN picked p USING (person_id, person_episode_number)""")

# -- merge -----------------------------------------------------------------------------------
cte("meet", """SELECT h.person_id, h.episode AS hip_episode, p.person_episode_number AS pps_episode FROM hip h JOIN pps p
 ON p.person_id = h.person_id AND (
 (h.estimated_start_date = p.episode_min_date AND h.visit_date = p.episode_max_date_plus_two_months)
 OR (h.estimated_start_date < p.episode_min_date AND h.visit_date > p.episode_max_date_plus_two_months)
 OR (h.estimated_start_date > p.episode_min_date AND h.visit_date < p.episode_max_date_plus_two_months)
 OR (h.estimated_start_date >= p.episode_min_date AND h.estimated_start_date <= p.episode_max_date_plus_two_months)
 OR (p.episode_min_date >= h.estimated_start_date AND p.episode_min_date <= h.visit_date)
 OR (h.visit_date >= p.episode_min_date AND h.visit_date <= p.episode_max_date_plus_two_months)
 OR (p.episode_max_date_plus_two_months >= h.estimated_start_date AND p.episode_max_date_plus_two_months <= h.visit_date))""")
cte("meet_all", """SELECT * FROM meet UNION ALL
 SELECT person_id, episode, NULL FROM hip WHERE (person_id, episode) NOT IN (SELECT (person_id, hip_episode) FROM meet)
 UNION ALL SELECT person_id, NULL, person_episode_number FROM pps
 WHERE (person_id, person_episode_number) NOT IN (SELECT (person_id, pps_episode) FROM meet)""")


def months_between(late: str, early: str) -> str:
    """Whole months for equal days or two month ends, else with a 31-day month."""
    return f"""round(CASE WHEN day({late}) = day({early}) OR (last_day({late}) = {late} AND last_day({early}) = {early})
 THEN 12 * (year({late}) - year({early})) + month({late}) - month({early})
 ELSE 12 * (year({late}) - year({early})) + month({late}) - month({early}) + (day({late}) - day({early})) / 31 END, 8)"""


def merged_dates(source: str) -> str:
    return f"""SELECT *, CAST({months_between('merged_episode_end', 'merged_episode_start')} AS DOUBLE)
 AS merged_episode_length FROM (SELECT *, least(first_gest_date, episode_min_date, pregnancy_end) AS merged_episode_start,
 greatest(episode_max_date, pregnancy_end) AS merged_episode_end FROM ({source}))"""


def repeats(side: str) -> str:
    return (f"CASE WHEN {side}_episode IS NOT NULL THEN CAST(count(*) OVER (PARTITION BY m.person_id, {side}_episode) > 1 "
            f"AS INT) END AS {side}_dup")


cte("joined", merged_dates(f"""SELECT m.*, h.visit_date AS pregnancy_end, h.estimated_start_date AS pregnancy_start,
 h.gest_date AS first_gest_date, h.category, p.episode_min_date, p.episode_max_date, p.pps_category, p.pps_outcome_date,
 {repeats('hip')}, {repeats('pps')}
 FROM meet_all m LEFT JOIN hip h ON h.person_id = m.person_id AND h.episode = m.hip_episode
 LEFT JOIN pps p ON p.person_id = m.person_id AND p.person_episode_number = m.pps_episode"""))
HIP_SIDE = ("hip_episode", "pregnancy_end", "pregnancy_start", "first_gest_date", "category")
PPS_SIDE = ("pps_episode", "episode_min_date", "episode_max_date", "pps_category", "pps_outcome_date")


def cleared(name: str, source: str, columns: tuple[str, ...], best: str, condition: str) -> None:
    """One step of taking repeats apart; ``best`` is an aggregate over the rows b of one episode."""
    replace = ", ".join(f"CASE WHEN NOT gone THEN {c} END AS {c}" for c in columns)
    cte(name, f"""SELECT * EXCLUDE (gone) REPLACE ({replace}) FROM (
 SELECT a.*, coalesce({condition.format(best=f'({best})')}, false) AS gone FROM {source} a)""")


APART = "abs({0}.pregnancy_end - {0}.episode_max_date)"
LENGTH = "abs({0}.episode_max_date - {0}.episode_min_date)"
cte("dup0", "SELECT * EXCLUDE (merged_episode_start, merged_episode_end, merged_episode_length) FROM joined "
    "WHERE hip_dup = 1 OR pps_dup = 1")
cleared("dup1", "dup0", HIP_SIDE,
        f"SELECT min({APART.format('b')}) FROM dup0 b WHERE b.person_id = a.person_id AND b.hip_episode = a.hip_episode",
        "hip_dup = 1 AND " + APART.format("a") + " <> {best}")
cleared("dup2", "dup1", HIP_SIDE + PPS_SIDE,
        f"SELECT max({LENGTH.format('b')}) FROM dup1 b WHERE b.person_id = a.person_id AND b.hip_episode = a.hip_episode",
        "hip_dup = 1 AND " + LENGTH.format("a") + " <> {best}")
cleared("dup3", "dup2", PPS_SIDE,
        f"SELECT min({APART.format('b')}) FROM dup2 b WHERE b.person_id = a.person_id AND b.pps_episode = a.pps_episode",
        "pps_dup = 1 AND (a.pregnancy_end IS NULL OR " + APART.format("a") + " <> {best})")
cleared("dup4", "dup3", PPS_SIDE,
        "SELECT max(b.pregnancy_end) FROM dup3 b WHERE b.person_id = a.person_id AND b.pps_episode = a.pps_episode",
        "pps_dup = 1 AND a.pregnancy_end <> {best}")
SIDES = "person_id, " + ", ".join(HIP_SIDE + PPS_SIDE)
cte("dup5", f"SELECT DISTINCT ON (person_id, hip_episode, episode_min_date, episode_max_date) {SIDES} FROM dup4 "
    "ORDER BY person_id, hip_episode, episode_min_date, episode_max_date, pps_episode NULLS FIRST")
cte("deduped", f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY person_id
 ORDER BY merged_episode_start NULLS FIRST, merged_episode_end NULLS FIRST, hip_episode NULLS FIRST,
 pps_episode NULLS FIRST) AS INT) AS episode_num FROM ({merged_dates(f'''SELECT *, {repeats('hip')}, {repeats('pps')}
 FROM (SELECT * FROM dup5 UNION ALL SELECT {SIDES} FROM joined WHERE coalesce(hip_dup, 0) = 0 AND coalesce(pps_dup, 0) = 0) m''')}))
 WHERE merged_episode_start IS NOT NULL""")
BORN_FIRST = "CAST(year_of_birth || '-' || month_of_birth || '-1' AS DATE)"
cte("detail", f"""SELECT d.person_id, p.data_partner_id, p.year_of_birth, p.month_of_birth, p.race_concept_name,
 p.ethnicity_concept_name, p.location_id, CAST(hip_episode IS NOT NULL AS INT) AS hip_flag,
 CAST(pps_episode IS NOT NULL AS INT) AS pps_flag, category AS hip_outcome_category, pregnancy_end AS hip_end_date,
 pps_category AS pps_outcome_category, pps_outcome_date AS pps_end_date,
 merged_episode_start AS recorded_episode_start, merged_episode_end AS recorded_episode_end,
 merged_episode_length AS recorded_episode_length, {BORN_FIRST} AS date_of_birth,
 CAST(row_number() OVER (PARTITION BY d.person_id ORDER BY merged_episode_start, merged_episode_end,
 hip_episode NULLS FIRST, pps_episode NULLS FIRST) AS INT) AS episode_number
 FROM deduped d LEFT JOIN f_person p ON p.person_id = d.person_id""")

# -- start dates -----------------------------------------------------------------------------
cte("time_records", """SELECT * FROM f_event WHERE domain <> 'drug' AND (lower(concept_name) LIKE '%gestation period,%'
 OR concept_id IN (SELECT concept_id FROM f_ages) OR concept_id IN (SELECT domain_concept_id FROM f_pps))""")
cte("time_in", """SELECT t.*, d.episode_number, d.recorded_episode_start, d.recorded_episode_end FROM time_records t
 JOIN detail d ON d.person_id = t.person_id
 AND t.event_date BETWEEN d.recorded_episode_start AND d.recorded_episode_end""")
cte("time_value", """SELECT *, CAST(trunc(try_cast(replace(replace(replace(replace(replace(
 CASE domain WHEN 'observation' THEN value_as_string WHEN 'measurement' THEN CAST(value_as_number AS VARCHAR)
 ELSE concept_name END, '|text_result_val:', ''), '|mapped_text_result_val:', ''), 'Gestation period, ', ''),
 'gestation period, ', ''), ' weeks', '') AS DOUBLE)) AS INT) AS domain_value FROM time_in""")
cte("time_start", f"""SELECT *, CASE WHEN lower(concept_name) LIKE '%gestation period,%' THEN event_date - 7 * domain_value
 WHEN is_age AND domain_value < {P.max_week_value} THEN event_date - 7 * domain_value END AS extrapolated_preg_start
 FROM (SELECT *, concept_id IN (SELECT concept_id FROM f_ages) AS is_age FROM time_value)""")
cte("timed", "SELECT t.*, m.min_month, m.max_month FROM time_start t LEFT JOIN pps_months m USING (concept_id)")
cte("classified", """SELECT * FROM (SELECT *, CASE WHEN concept_name LIKE '%Gestation period%' OR is_age THEN
 CASE WHEN domain_value IS NOT NULL AND extrapolated_preg_start IS NOT NULL THEN 'GW' END
 WHEN min_month IS NOT NULL THEN 'GR3m' END AS gt_type FROM timed) WHERE gt_type IS NOT NULL""")
cte("bounded", f"""SELECT *,
 CASE WHEN gt_type = 'GR3m' THEN event_date - CAST(round(min_month * {P.days_per_month}) AS INT) END AS min_pregnancy_start,
 CASE WHEN gt_type = 'GR3m' THEN event_date - CAST(round(max_month * {P.days_per_month}) AS INT) END AS max_pregnancy_start
 FROM classified""")
cte("evidence", """SELECT DISTINCT ON (person_id, episode_number, rollup_name, event_date, gt_type) * FROM (
 SELECT *, CASE WHEN domain_value IS NOT NULL THEN 'Gestation Week' ELSE concept_name END AS rollup_name FROM bounded)
 ORDER BY person_id, episode_number, rollup_name, event_date, gt_type, domain_value DESC NULLS LAST, concept_id,
 concept_name""")
cte("gw", """SELECT person_id, episode_number, event_date, concept_id, domain_value,
 coalesce(extrapolated_preg_start, min_pregnancy_start, max_pregnancy_start) AS d FROM evidence
 WHERE extrapolated_preg_start IS NOT NULL OR min_pregnancy_start IS NULL OR max_pregnancy_start IS NULL""")
cte("gr", """SELECT *, row_number() OVER () AS id FROM (SELECT person_id, episode_number,
 least(min_pregnancy_start, max_pregnancy_start) AS s, greatest(min_pregnancy_start, max_pregnancy_start) AS e
 FROM evidence WHERE extrapolated_preg_start IS NULL AND min_pregnancy_start IS NOT NULL
 AND max_pregnancy_start IS NOT NULL)""")
cte("lists", """SELECT e.person_id, e.episode_number, CAST(max(CAST(gt_type = 'GW' AS INT)) AS INT) AS gw_flag,
 CAST(max(CAST(gt_type = 'GR3m' AS INT)) AS INT) AS gr3m_flag,
 coalesce(any_value(w.weeks), '') AS weeks, coalesce(any_value(r.ranges), '') AS ranges FROM evidence e
 LEFT JOIN (SELECT person_id, episode_number, string_agg(strftime(d, '%Y-%m-%d') || 'x' || n, ';' ORDER BY v DESC NULLS LAST,
  event_date, concept_id) AS weeks FROM (SELECT person_id, episode_number, d, count(*) AS n,
  first(domain_value ORDER BY domain_value DESC NULLS LAST, event_date, concept_id) AS v,
  first(event_date ORDER BY domain_value DESC NULLS LAST, event_date, concept_id) AS event_date,
  first(concept_id ORDER BY domain_value DESC NULLS LAST, event_date, concept_id) AS concept_id
  FROM gw GROUP BY person_id, episode_number, d) GROUP BY ALL) w USING (person_id, episode_number)
 LEFT JOIN (SELECT person_id, episode_number, string_agg(strftime(s, '%Y-%m-%d') || '/' || strftime(e, '%Y-%m-%d') || 'x' || n,
  ';' ORDER BY s, e) AS ranges FROM (SELECT person_id, episode_number, s, e, count(*) AS n FROM gr GROUP BY ALL)
  GROUP BY ALL) r USING (person_id, episode_number) GROUP BY ALL""")
cte("gr_counts", """SELECT j.*, (SELECT count(*) FROM gr m WHERE m.person_id = j.person_id
 AND m.episode_number = j.episode_number AND m.id <> j.id AND (m.s = j.s OR m.s = j.e OR m.e = j.s OR m.e = j.e
 OR (m.e > j.s AND m.e < j.e) OR (m.s > j.s AND m.s < j.e))) AS n_overlap FROM gr j""")
cte("gr_limits", """SELECT person_id, episode_number, abs(quantile_cont(n_overlap, 0.25)
 - 1.5 * (quantile_cont(n_overlap, 0.75) - quantile_cont(n_overlap, 0.25))) AS overlap_threshold
 FROM gr_counts GROUP BY ALL""")
cte("gr_kept", """SELECT c.*, overlap_threshold, CASE WHEN overlap_threshold = 0 THEN n_overlap <> 0
 ELSE n_overlap >= overlap_threshold END AS kept FROM gr_counts c JOIN gr_limits USING (person_id, episode_number)""")
cte("gr_basis", """SELECT person_id, episode_number, any_value(overlap_threshold) AS overlap_threshold,
 count(*) FILTER (kept) AS n_kept, coalesce(
 list(struct_pack(ss := s, se := e, cs := s, ce := e) ORDER BY n_overlap DESC, s, e) FILTER (kept),
 list(struct_pack(ss := s, se := e, cs := s, ce := e) ORDER BY n_overlap DESC, s, e)[1:1]) AS basis
 FROM gr_kept GROUP BY ALL""")
cte("gr_list", """SELECT person_id, episode_number, string_agg(strftime(s, '%Y-%m-%d') || '/' || strftime(e, '%Y-%m-%d') || 'x' || n,
 ';' ORDER BY n_overlap DESC, s, e) AS kept FROM (SELECT person_id, episode_number, s, e, n_overlap, count(*) AS n
 FROM gr_kept WHERE kept GROUP BY ALL) GROUP BY ALL""")
cte("gr_core", """SELECT person_id, episode_number, overlap_threshold, n_kept, list_reduce(basis, lambda a, x: struct_pack(
 ss := least(a.ss, x.ss), se := greatest(a.se, x.se),
 cs := CASE WHEN x.ss > a.cs AND x.ss < (CASE WHEN x.se < a.ce AND x.se > a.cs THEN x.se ELSE a.ce END)
  THEN x.ss ELSE a.cs END,
 ce := CASE WHEN x.se < a.ce AND x.se > a.cs THEN x.se ELSE a.ce END)) AS f FROM gr_basis""")
cte("gr_shown", """SELECT c.person_id, c.episode_number, overlap_threshold, n_kept, coalesce(l.kept, '') AS kept
 FROM gr_core c LEFT JOIN gr_list l USING (person_id, episode_number)""")
cte("cores", f"""SELECT person_id, episode_number, f.ss AS span_start, f.se AS span_end, f.cs AS raw_start, f.ce AS raw_end,
 f.cs + CAST(floor((f.ce - f.cs) / 2) AS INT) AS core_midpoint, CAST(f.se - f.ss AS INT) AS range_days,
 CASE WHEN f.ce - f.cs < {P.min_core_days} THEN f.cs + CAST(floor((f.ce - f.cs) / 2) AS INT) - {P.core_half_width}
  ELSE f.cs END AS core_start,
 CASE WHEN f.ce - f.cs < {P.min_core_days} THEN f.cs + CAST(floor((f.ce - f.cs) / 2) AS INT) + {P.core_half_width}
  ELSE f.ce END AS core_end FROM gr_core""")
cte("gw_share", f"""SELECT person_id, episode_number, count(*) AS n_weeks, any_value(core_start) AS core_start,
 coalesce(100 * count(*) FILTER (d BETWEEN core_start AND core_end) / count(*) > {P.majority_percent}, false) AS majority
 FROM gw LEFT JOIN cores USING (person_id, episode_number) GROUP BY ALL""")
cte("gw_used", """SELECT g.*, s.majority FROM gw g JOIN gw_share s USING (person_id, episode_number)
 LEFT JOIN cores c USING (person_id, episode_number)
 WHERE NOT s.majority OR g.d BETWEEN c.core_start AND c.core_end""")


def week_filter(name: str, source: str) -> None:
    cte(f"{name}_away", f"""SELECT g.*, abs(d - median) AS away FROM {source} g JOIN (
 SELECT person_id, episode_number, list(d ORDER BY d)[1 + CAST(floor(count(*) / 2) AS INT)] AS median
 FROM {source} GROUP BY ALL) USING (person_id, episode_number)""")
    cte(f"{name}_good", f"""SELECT a.* FROM {name}_away a JOIN (SELECT person_id, episode_number,
 quantile_cont(away, 0.25) AS q1, quantile_cont(away, 0.75) AS q3 FROM {name}_away GROUP BY ALL)
 USING (person_id, episode_number) WHERE away >= q1 - 1.5 * (q3 - q1) AND away <= q3 + 1.5 * (q3 - q1)""")


week_filter("gw_used", "gw_used")
week_filter("gw_all", "gw")
FIRST = "ORDER BY domain_value DESC NULLS LAST, event_date, concept_id"
cte("gw_all_list", f"""SELECT person_id, episode_number, string_agg(strftime(d, '%Y-%m-%d') || 'x' || n, ';'
 ORDER BY v DESC NULLS LAST, e, c) AS good FROM (SELECT person_id, episode_number, d, count(*) AS n,
 first(domain_value {FIRST}) AS v, first(event_date {FIRST}) AS e, first(concept_id {FIRST}) AS c
 FROM gw_all_good GROUP BY person_id, episode_number, d) GROUP BY ALL""")
PRECISION = """CASE WHEN precision_days = -1 THEN 'week_poor-support' WHEN precision_days BETWEEN 0 AND 7 THEN 'week'
 WHEN precision_days BETWEEN 8 AND 14 THEN 'two-week' WHEN precision_days BETWEEN 15 AND 21 THEN 'three-week'
 WHEN precision_days BETWEEN 22 AND 28 THEN 'month' WHEN precision_days BETWEEN 29 AND 56 THEN 'two-month'
 WHEN precision_days BETWEEN 57 AND 84 THEN 'three-month' ELSE 'non-specific' END"""
cte("info", f"""SELECT *, {PRECISION} AS precision_category FROM (SELECT l.*,
 CASE WHEN s.n_weeks > 0 THEN w.start ELSE c.core_midpoint END AS inferred_episode_start,
 CAST(CASE WHEN s.n_weeks > 0 THEN CASE WHEN NOT s.majority AND w.n = 1 THEN -1 ELSE w.spread END
  ELSE c.range_days END AS INT) AS precision_days,
 CAST(coalesce(s.n_weeks > 0 AND c.core_start IS NOT NULL, false) AS INT) AS intervals_count,
 CAST(coalesce(s.majority, false) AS INT) AS majority_overlap_count FROM lists l
 LEFT JOIN cores c USING (person_id, episode_number) LEFT JOIN gw_share s USING (person_id, episode_number)
 LEFT JOIN (SELECT person_id, episode_number, count(*) AS n, max(d) - min(d) AS spread,
  first(d ORDER BY domain_value DESC NULLS LAST, event_date, concept_id) AS start
  FROM gw_used_good GROUP BY ALL) w USING (person_id, episode_number))""")
cte("overlap_stats", """SELECT CAST(sum(intervals_count) AS BIGINT) AS intervals_total,
 CAST(sum(majority_overlap_count) AS BIGINT) AS majority_total,
 100 * sum(majority_overlap_count) / nullif(sum(intervals_count), 0) AS majority_percent FROM info""")

# -- final table -----------------------------------------------------------------------------
cte("meta_timing", """SELECT d.*, coalesce(i.gw_flag, 0) AS gw_flag, coalesce(i.gr3m_flag, 0) AS gr3m_flag,
 i.inferred_episode_start AS evidence_start, i.precision_days AS evidence_days, i.precision_category AS evidence_category
 FROM detail d LEFT JOIN info i USING (person_id, episode_number)""")
cte("meta_match", f"""SELECT *, CASE WHEN hip_outcome_category = 'PREG' AND pps_outcome_category = 'PREG' THEN 1
 WHEN hip_outcome_category = pps_outcome_category AND hip_outcome_category <> 'PREG'
 AND abs(hip_end_date - pps_end_date) <= {P.match_window_days} THEN 1 ELSE 0 END AS outcome_match FROM meta_timing""")


def ladder(hip: str, pps: str) -> str:
    return f"""CASE WHEN outcome_match = 1 THEN {hip} WHEN pps_outcome_category IS NULL THEN {hip}
 WHEN hip_outcome_category IS NULL THEN {pps} WHEN hip_outcome_category <> 'PREG' AND pps_outcome_category <> 'PREG'
 AND hip_end_date <= pps_end_date - {P.later_outcome_days} THEN {pps} ELSE {hip} END"""


cte("meta_end", f"""SELECT *, {ladder('hip_outcome_category', 'pps_outcome_category')} AS final_outcome_category,
 {ladder('hip_end_date', 'pps_end_date')} AS inferred_episode_end FROM meta_match""")
cte("meta_start", f"""SELECT *, coalesce(evidence_category, {PRECISION}) AS precision_category FROM (
 SELECT m.*, t.min_term, t.max_term, coalesce(evidence_start, inferred_episode_end - t.max_term) AS inferred_episode_start,
 coalesce(evidence_days, t.max_term - t.min_term) AS precision_days
 FROM meta_end m LEFT JOIN f_terms t ON t.category = m.final_outcome_category)""")
cte("meta_term", f"""SELECT *, CASE WHEN gestational_age_days_calculated BETWEEN min_term AND max_term THEN 1
 WHEN final_outcome_category = 'PREG' AND gestational_age_days_calculated <= {P.open_term_days} THEN 1 ELSE 0 END
 AS term_duration_flag FROM (SELECT *, CAST(inferred_episode_end - inferred_episode_start AS INT)
 AS gestational_age_days_calculated FROM meta_start)""")
cte("meta_score", """SELECT *, CASE WHEN outcome_match = 1 AND term_duration_flag = 1 THEN 2
 WHEN outcome_match = 0 AND term_duration_flag = 1 THEN 1 ELSE 0 END AS outcome_concordance_score FROM meta_term""")
cte("meta_age", """SELECT *, CAST(inferred_episode_start - date_of_birth AS INT) AS birth_date_diff,
 (inferred_episode_start - date_of_birth) / 365 AS age_at_inferred_start FROM meta_score""")
cte("meta_race", """SELECT *, CASE WHEN ethnicity = 'Hispanic or Latino' THEN 'Hispanic or Latino Any Race'
 WHEN race = 'Unknown' THEN 'Unknown' ELSE race || ' Non-Hispanic' END AS race_ethnicity FROM (SELECT *,
 CASE WHEN race_concept_name IN ('Asian','Asian Indian','Chinese','Korean','Vietnamese','Filipino','Japanese') THEN 'Asian'
 WHEN race_concept_name IN ('Black','Black or African American') THEN 'Black'
 WHEN race_concept_name IN ('Other Pacific Islander','Native Hawaiian or Other Pacific Islander','Polynesian')
 THEN 'Native Hawaiian or Other Pacific Islander'
 WHEN race_concept_name IS NULL OR race_concept_name IN ('No information','No matching concept','Refuse to answer',
 'Unknown','Unknown racial group') THEN 'Unknown' WHEN race_concept_name = 'White' THEN 'White' ELSE 'Other' END AS race,
 CASE WHEN ethnicity_concept_name = 'Not Hispanic or Latino' THEN 'Not Hispanic or Latino'
 WHEN ethnicity_concept_name = 'Hispanic or Latino' OR race_concept_name = 'Hispanic' THEN 'Hispanic or Latino'
 ELSE 'Unknown' END AS ethnicity FROM meta_age)""")
cte("final", f"""SELECT *, CASE WHEN gestational_age_days_calculated < {P.preterm_days} THEN 1 ELSE 0 END
 AS preterm_status_from_calculation FROM meta_race""")
cte("period", """SELECT min(recorded_episode_start) AS min_episode_date, max(recorded_episode_end) AS max_episode_date,
 min(inferred_episode_start) AS min_pregnancy_date, max(inferred_episode_end) AS max_pregnancy_date FROM final""")


def needed(name: str) -> list[str]:
    """The expressions a name rests on, in order of definition."""
    names, seen, todo = list(CTES), set(), [name]
    while todo:
        current = todo.pop()
        if current in seen:
            continue
        seen.add(current)
        words = set(re.findall(r"\w+", CTES[current]))
        todo += [n for n in names if n in words and n != current and names.index(n) < names.index(current)]
    return [n for n in names if n in seen]


def select(name: str, columns: str, where: str = "") -> str:
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in needed(name))
    return f"WITH {ctes}\nSELECT {columns} FROM {name}{' WHERE ' + where if where else ''}"
