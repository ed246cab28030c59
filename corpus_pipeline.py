"""A corpus pipeline: toxicity, near-duplicates, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. run() writes every stage's result as Parquet to the shared folder and hands the next stage what it
reads back. Labels and benchmark come from sf_dir; the two trained models learn from the labelled rows of
the stage's own input.

Defined results: each stage keeps the conventions of its operator for nulls, empty and long texts, ties, repeated
rows and empty tables. Toxicity drops predicted documents only. Near-duplicates keep one row of each class. Decontamination drops
documents with a leaked window. Mixing keeps every document at least once and repeats rows of scarce domains. Sharding adds shard,
shard_depth and n_bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shardlore.llm import common, decontaminate, mixing, neardup, sharding, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not predict toxic."""
    return toxicity.decide(docs, docs, common.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return neardup.decide(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.decide(docs, common.table(spark, sf_dir, "benchmark"))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, as often as the target weights of their domains ask for."""
    return mixing.decide(docs, common.table(spark, sf_dir, "labels"), docs)


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the shard that each belongs to."""
    return sharding.assign(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_domains),
    ("sharding", place_in_shards),
]

#: Training, projected gradient and exact set joins over many rounds have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    docs = common.table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = common.stage(function(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
