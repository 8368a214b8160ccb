"""A corpus pipeline over `documents`: every stage takes all rows that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from storkline.llm.decontaminate import drop_leaks
from storkline.llm.near_dups import drop_near_duplicates
from storkline.llm.personal_data import mask
from storkline.llm.pieces import encode, read_pieces
from storkline.llm.queries import VOCABULARY
from storkline.llm.rule_ensemble import keep_good
from storkline.session import cut

#: what Spark hands to a Python worker at once, as much as the operators take of it at a time; a task holds it in the
#: JVM and in the worker
BATCH_BYTES = "2m"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """The stage with BATCH_BYTES set in its session, where it stays: the frame returned is evaluated later."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        return stage(spark, docs, sf_dir)
    return run


@in_small_batches
def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@in_small_batches
def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return drop_near_duplicates(docs)


@in_small_batches
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@in_small_batches
def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    return mask(docs)


@in_small_batches
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their texts."""
    return encode(docs, read_pieces(VOCABULARY))


STAGES = [
    ("rule_ensemble_quality", select_quality),
    ("minhash_near_dedup", deduplicate),
    ("simhash_decontamination", decontaminate),
    ("bilstm_crf_pii", mask_personal_data),
    ("sentencepiece_shared_prefix", tokenize),
]

#: the stages are models and searches, which SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the whole table, each to the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for position, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if position < len(STAGES) - 1:
            docs = cut(docs)
    return docs
