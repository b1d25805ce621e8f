"""From raw documents to shards: toxic texts out, one text of each group of near copies, benchmark texts out, sources
mixed to target weights, and the result dealt into shards of limited size.

Each stage takes ``(spark, docs, sf_dir)``, works on all its predecessor kept, and is written before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loanvane.llm import factorization, group_join, mixing, positional_index, sharding
from loanvane.llm.queries import table
from loanvane.llm.shared import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a toxicity score under 0.7, learned from the labels of the documents at hand."""
    return factorization.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every component of texts linked at Jaccard 0.75 over five-word shingles."""
    return group_join.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any ten-word window of a benchmark item."""
    return positional_index.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in up to two copies, so that each source's words meet its target."""
    return mixing.repeat_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with the shard they belong to."""
    return sharding.extendible_shards(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("benchmark", drop_benchmark),
    ("mixing", mix),
    ("sharding", shard),
]

# Trained scores and Newton steps have no counterpart in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
