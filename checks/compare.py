"""Run every query on Spark and on DuckDB and compare the rows, order aside.

    python -m checks.compare [--fresh] [sf_dir] [name part ...]

All queries share one set of stages; with ``--fresh`` each starts from the tables.
"""

from __future__ import annotations

import glob
import os
import sys
import time
from collections import Counter

import duckdb

from checks.queries import QUERIES, Steps
from storkline.session import build_session


def oracle_rows(connection, sql: str) -> tuple[list[str], list[tuple]]:
    result = connection.execute(sql)
    return [d[0] for d in result.description], result.fetchall()


def normal(columns: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def open_oracle(sf_dir: str):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def main() -> int:
    fresh = "--fresh" in sys.argv
    rest = [a for a in sys.argv[1:] if a != "--fresh"]
    sf_dir, wanted = (rest[0] if rest else "/root/testdata/sf0.01"), rest[1:]
    spark = build_session(
        "compare", **{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                      "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, bad, shared = open_oracle(sf_dir), 0, Steps(spark, sf_dir)
    for name, query in QUERIES.items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            begin = time.time()
            df = query.run(spark, sf_dir) if fresh else query.frame(shared)
            ours = normal(df.columns, [tuple(r) for r in df.collect()])
            middle = time.time()
            columns, rows = oracle_rows(connection, query.sql())
            theirs = normal(columns, rows)
            same = ours == theirs and sorted(df.columns) == sorted(columns)
            print(f"{'ok  ' if same else 'DIFF'} {name} rows={sum(ours.values())}/{sum(theirs.values())} "
                  f"spark={middle - begin:.1f}s duckdb={time.time() - middle:.1f}s", flush=True)
            if not same:
                bad += 1
                print("   columns", sorted(df.columns))
                print("   ours  ", list((ours - theirs).items())[:3])
                print("   theirs", list((theirs - ours).items())[:3], flush=True)
        except Exception as error:  # report and go on with the next query
            bad += 1
            print(f"FAIL {name}: {type(error).__name__}: {str(error)[:700]}", flush=True)
    print(f"{bad} of the queries differ")
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
