"""Reading OMOP tables and code lists from files."""

from datetime import date

from storkline.sources.omop import DOMAINS, read_list, read_tables


def test_domain_tables_become_events(spark, tmp_path):
    for domain, table, concept, name, when, record in DOMAINS:
        columns = f"person_id int, {concept} int, {name} string, {when} date, {record} int"
        row = (1, 5, domain, date(2020, 1, 2), 9)
        df = spark.createDataFrame([row], columns)
        if domain == "measurement":
            df = df.selectExpr("*", "CAST(3.5 AS DOUBLE) AS value_as_number")
        df.write.parquet(f"{tmp_path}/{table}")
    for table in ("person", "visit_occurrence", "concept", "concept_relationship"):
        spark.range(1).write.parquet(f"{tmp_path}/{table}")
    rows = {r.domain: r for r in read_tables(spark, str(tmp_path)).event.collect()}
    assert set(rows) == {d[0] for d in DOMAINS}
    assert all((r.person_id, r.concept_id, r.event_date, r.record_id) == (1, 5, date(2020, 1, 2), 9) for r in rows.values())
    assert (rows["measurement"].value_as_number, rows["drug"].value_as_number) == (3.5, None)


def test_code_list_from_csv(spark, tmp_path):
    path = tmp_path / "terms.csv"
    path.write_text("retry,category,max_term,min_term\n28,LB,301,161\n")
    assert [tuple(r) for r in read_list(spark, "terms", str(path)).collect()] == [("LB", 161, 301, 28)]
