"""The shared Parquet tables seen as OMOP tables and code lists.

Every value here is made up for checks and has no clinical meaning. The same text runs on
Spark and on DuckDB; base tables stand in braces.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from storkline import Lists, Params, Tables

BASE = ("customer", "part", "orders", "lineitem")

_GROUPS = ("LB", "SB", "ECT", "AB", "DELIV")
_LIMITS = ", ".join(
    f"('{a}', '{b}', {(168 if b in ('LB', 'SB', 'DELIV') else 56) + 5 * i + j})"  # no two alike
    for i, a in enumerate(_GROUPS) for j, b in enumerate(_GROUPS)
)

VIEWS = {
    "f_person": """
SELECT c_custkey AS person_id,
 CASE WHEN c_custkey % 5 = 0 THEN 'MALE' ELSE 'FEMALE' END AS gender_concept_name,
 CAST(1955 + c_custkey % 40 AS INT) AS year_of_birth, CAST(1 + c_custkey % 12 AS INT) AS month_of_birth,
 CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(1 + c_custkey % 28 AS INT) END AS day_of_birth,
 CASE c_custkey % 6 WHEN 0 THEN 'White' WHEN 1 THEN 'Black' WHEN 2 THEN 'Chinese' WHEN 3 THEN 'Unknown'
  WHEN 4 THEN 'Polynesian' END AS race_concept_name,
 CASE c_custkey % 4 WHEN 0 THEN 'Hispanic or Latino' WHEN 1 THEN 'Not Hispanic or Latino'
  ELSE 'No information' END AS ethnicity_concept_name,
 c_nationkey AS data_partner_id, c_nationkey AS location_id
FROM {customer}""",
    "f_concept": """
SELECT p_partkey AS concept_id, p_name AS concept_name,
 CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'C' ELSE 'S' END AS standard_concept
FROM {part}""",
    "f_concept_relationship": """
SELECT p_partkey AS concept_id_1, p_partkey + 2 AS concept_id_2,
 CASE WHEN p_partkey % 10 = 0 THEN 'Maps to' ELSE 'Is a' END AS relationship_id,
 DATE '1970-01-01' AS valid_start_date, DATE '2099-12-31' AS valid_end_date,
 CAST(NULL AS VARCHAR(1)) AS invalid_reason
FROM {part}""",
    "f_hip": """
SELECT p_partkey AS concept_id, p_name AS concept_name,
 CASE p_partkey % 32 WHEN 0 THEN 'LB' WHEN 1 THEN 'SB' WHEN 2 THEN 'ECT' WHEN 3 THEN 'AB' WHEN 4 THEN 'SA'
  WHEN 5 THEN 'DELIV' ELSE 'PREG' END AS category,
 CASE WHEN p_partkey % 32 IN (6, 7) THEN CAST(4 + (p_partkey * 7) % 42 AS INT) END AS gest_value
FROM {part} WHERE p_partkey % 32 <= 8""",
    "f_initial": "SELECT p_partkey AS concept_id, 'LB' AS category FROM {part} WHERE p_partkey % 32 = 0",
    "f_pps": """
SELECT p_partkey AS domain_concept_id, p_name AS domain_concept_name,
 CAST(p_partkey % 8 AS DOUBLE) AS min_month, CAST(p_partkey % 8 + p_partkey % 3 AS DOUBLE) AS max_month
FROM {part} WHERE p_partkey % 32 BETWEEN 8 AND 11""",
    "f_ages": "SELECT p_partkey AS concept_id FROM {part} WHERE p_partkey % 32 = 8",
    "f_denied": "SELECT p_partkey AS concept_id FROM {part} WHERE p_partkey % 7 = 3",
    "f_event": """
SELECT o.o_custkey AS person_id,
 CASE l.l_linenumber % 5 WHEN 0 THEN 'drug' WHEN 1 THEN 'condition' WHEN 2 THEN 'procedure'
  WHEN 3 THEN 'observation' ELSE 'measurement' END AS domain,
 l.l_partkey AS concept_id,
 CASE WHEN l.l_partkey % 32 IN (6, 7)
  THEN 'Gestation period, ' || CAST(4 + (l.l_partkey * 7) % 42 AS VARCHAR(4)) || ' weeks'
  ELSE p.p_name END AS concept_name,
 CAST(l.l_shipdate AS DATE) + k.later AS event_date, c.c_nationkey AS data_partner_id,
 l.l_quantity + k.more AS value_as_number,
 CASE WHEN l.l_linenumber % 2 = 1 THEN CAST(CAST(floor(l.l_quantity) + k.more AS INT) AS VARCHAR(8)) ELSE 'n/a' END
  AS value_as_string,
 (l.l_orderkey * 10 + l.l_linenumber) * 100 + k.later * 2 + k.more AS record_id
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
 JOIN {part} p ON l.l_partkey = p.p_partkey JOIN {customer} c ON o.o_custkey = c.c_custkey
 JOIN (VALUES (0, 0, 0), (1, 0, 0), (1, 0, 1), (1, 2, 0), (1, 5, 0), (1, 9, 1), (1, 14, 0), (1, 20, 0), (1, 27, 0),
  (1, 35, 1)) AS k(kind, later, more)
 ON k.kind = CASE WHEN l.l_partkey % 32 BETWEEN 6 AND 11 AND o.o_orderkey % 8 = 0 THEN 1 ELSE 0 END""",
    "f_visit": """
SELECT o_custkey AS person_id, 1 + o_orderkey % 200 AS visit_concept_id, o_orderpriority AS visit_concept_name,
 CAST(o_orderdate AS DATE) AS visit_start_date
FROM {orders}""",
    "f_limits": f"SELECT * FROM (VALUES {_LIMITS}) AS t(first_preg_category, outcome_preg_category, min_days)",
    "f_terms": """
SELECT * FROM (VALUES ('LB', 161, 301, 28), ('SB', 140, 301, 28), ('DELIV', 140, 301, 28), ('ECT', 42, 84, 14),
 ('AB', 42, 168, 14), ('SA', 28, 139, 14), ('PREG', 0, 301, 14)) AS t(category, min_term, max_term, retry)""",
}

PARAMS = Params(
    study_start=date(1995, 1, 1), study_end=date(2001, 12, 31), birth_year_min=1960, birth_year_max=1990,
    min_persons=10, min_ratio=1.0, min_share=0.0, max_stddev=2.9, max_stddev_across=2.0,
    max_span_months=6, max_episodes_per_year=1,
)


def load(spark: SparkSession, sf_dir: str) -> tuple[Tables, Lists]:
    base = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in BASE}

    def view(name: str) -> DataFrame:
        used = {t: df for t, df in base.items() if "{" + t + "}" in VIEWS[name]}
        return spark.sql(VIEWS[name], **used)

    tables = Tables(
        person=view("f_person"), event=view("f_event"), visit=view("f_visit"), concept=view("f_concept"),
        concept_relationship=view("f_concept_relationship"),
    )
    hip = view("f_hip")
    lists = Lists(
        initial=view("f_initial"), outcomes=hip, months=view("f_pps"), limits=view("f_limits"),
        terms=view("f_terms"), ages=view("f_ages"), timing=view("f_ages"), denied=view("f_denied"),
    )
    return tables, lists
