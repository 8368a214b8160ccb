"""The whole run as a job.

    spark-submit --py-files storkline.zip storkline/job.py --tables /data/omop --lists /data/lists --out /data/result

``--tables`` is a folder, or a catalog database with ``--catalog``. ``--lists`` is a folder with one
CSV or Parquet file or folder per code list, named as in ``LIST_SCHEMAS``. Below ``--out`` the job writes
``episodes``, the final table, and with ``--concepts`` also ``specific_concepts`` and ``concept_summary``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from storkline.config import Params
from storkline.plans.pipeline import Pipeline
from storkline.session import build_session
from storkline.sources.omop import LIST_SCHEMAS, catalog_tables, read_lists, read_tables


def run(spark: SparkSession, tables: str, lists: str, out: str, catalog: bool = False, concepts: bool = False,
        suffix: str = ".csv", params: Params | None = None) -> None:
    source = catalog_tables(spark, tables) if catalog else read_tables(spark, tables)
    codes = read_lists(spark, {name: f"{lists}/{name}{suffix}" for name in LIST_SCHEMAS})
    pipeline = Pipeline(source, codes, params)
    pipeline.episodes.write.parquet(f"{out}/episodes")
    if concepts:
        pipeline.specific_concepts.write.parquet(f"{out}/specific_concepts")
        pipeline.concept_summary.write.parquet(f"{out}/concept_summary")


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    for name in ("tables", "lists", "out"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--catalog", action="store_true", help="--tables names a database of the catalog")
    parser.add_argument("--concepts", action="store_true", help="also write the concepts and their timing")
    parser.add_argument("--suffix", default=".csv", help="ending of the list files: .csv, .parquet or nothing")
    given = parser.parse_args()
    run(build_session("storkline"), given.tables, given.lists, given.out, given.catalog, given.concepts, given.suffix)


if __name__ == "__main__":
    main()
