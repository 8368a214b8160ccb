"""Concept statistics kept up to date load by load.

Each load of events is reduced once to its first records (`prevalence.first_records`), which go to a folder
of their own. The statistics come from the merged first records of all loads, so a new load adds to what is
there without a further look at earlier events, and a change of code lists or thresholds needs no events at all.
Merging takes a minimum: a load sent twice, or loads that share records, change nothing, and a late load
with older records moves a person's earliest record as if it had been there from the start.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from storkline.operators.prevalence import first_records, merge_first_records


def _finished(spark: SparkSession, folder: str) -> list[str]:
    """Folders of the loads that were written to the end."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/*/_SUCCESS")
    files = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getParent().toString() for f in files.globStatus(pattern) or [])


def add_load(event: DataFrame, folder: str, name: str) -> None:
    """Write the first records of a load. A load of the same name is replaced; one that broke off counts
    only after it is sent again. A load without events is a load as well."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9-]*", name):
        raise ValueError(f"a load is named by letters, digits and hyphens, not {name!r}")
    first_records(event).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def loaded(spark: SparkSession, folder: str) -> DataFrame:
    """The first records of all finished loads side by side: enough for the statistics, whose earliest
    record is the least of them merged or not."""
    loads = _finished(spark, folder)
    if not loads:
        raise ValueError(f"no finished load in {folder}")
    return spark.read.parquet(*loads)


def read_loads(spark: SparkSession, folder: str) -> DataFrame:
    """The first records of all finished loads, merged."""
    return merge_first_records(loaded(spark, folder))


def compact(spark: SparkSession, folder: str, into: str, name: str) -> None:
    """Write the merged first records of all loads of a folder as one load of another folder, which goes
    on in its place; nothing that is read is changed."""
    if folder.rstrip("/") == into.rstrip("/"):
        raise ValueError("loads are merged into a new folder")
    read_loads(spark, folder).write.parquet(f"{into.rstrip('/')}/{name}")
