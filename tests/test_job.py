"""The job from files or catalog tables to the final table."""

import pytest

from checks.fixture import PARAMS, load
from storkline import job
from storkline.plans.pipeline import Pipeline
from storkline.sources.omop import DOMAINS, LIST_SCHEMAS

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("catalog", [False, True])
def test_job_writes_the_final_table(spark, tmp_path, catalog):
    tables, lists = load(spark, SF_DIR)
    database = "omop_job"
    spark.sql(f"DROP DATABASE IF EXISTS {database} CASCADE")
    spark.sql(f"CREATE DATABASE {database} LOCATION '{tmp_path}/db'")

    def put(df, name):
        if catalog:
            df.write.saveAsTable(f"{database}.{name}")
        else:
            df.write.parquet(f"{tmp_path}/omop/{name}")

    for domain, table, concept, name, when, record in DOMAINS:
        put(tables.event.filter(f"domain = '{domain}'").selectExpr(
            "person_id", f"concept_id AS {concept}", f"concept_name AS {name}", f"event_date AS {when}", f"record_id AS {record}",
            "data_partner_id", "value_as_number", "value_as_string"), table)
    for name, df in (("person", tables.person), ("visit_occurrence", tables.visit), ("concept", tables.concept),
                     ("concept_relationship", tables.concept_relationship)):
        put(df, name)
    for name in LIST_SCHEMAS:
        getattr(lists, name).write.parquet(f"{tmp_path}/lists/{name}")
    job.run(spark, database if catalog else f"{tmp_path}/omop", f"{tmp_path}/lists", f"{tmp_path}/out", catalog, True, "", PARAMS)
    got = spark.read.parquet(f"{tmp_path}/out/episodes")
    assert got.count() > 100 and got.columns == Pipeline(tables, lists, PARAMS).episodes.columns
    assert spark.read.parquet(f"{tmp_path}/out/specific_concepts").count() > 0
    spark.sql(f"DROP DATABASE {database} CASCADE")
