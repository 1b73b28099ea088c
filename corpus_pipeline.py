"""A corpus pipeline of five stages: documents in, sharded training mixture out.

Each stage works on all that its predecessor kept, and its decisions take effect. All stages but the last return the columns of
documents; the last adds shard and slot.

Cases: every stage passes nulls, repeated rows, extra columns and empty tables on as its operator defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import decontamination, language_id, mixing, sharding, simhash
from evidentia.llm.common import discard, materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or that fit none of the learned languages, go."""
    return language_id.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mixture takes it: not at all, once or twice."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row with its shard and slot; equal texts share a shard."""
    return sharding.place(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mixture", mixture),
    ("shards", shards),
]
#: SQL cannot express the kernel model, the fingerprints or the drawn mixture; the test compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        done = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(docs)  # the stage before this one; the input is not a table of ours
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
