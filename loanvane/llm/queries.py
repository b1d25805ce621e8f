"""The corpus queries by name; each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanvane.llm import (
    class_lm,
    factorization,
    group_join,
    license_scan,
    line_cleaning,
    manifest,
    mixing,
    periodic_runs,
    positional_index,
    rule_ensemble,
    sharding,
    site_tree,
    zip_warc,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.extendible_shards(docs).drop("text")


def op2_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_factorization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factorization.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_site_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_tree.extract_main_text(table(spark, sf_dir, "pages"))


def op5_line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_cleaning.clean_by_lines(table(spark, sf_dir, "documents")).drop("clean_text")


def op6_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_join.similar_components(table(spark, sf_dir, "documents"))


def op8_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zip_warc.round_trip(table(spark, sf_dir, "pages")).drop("url", "payload")


def op9_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional_index.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score_documents(table(spark, sf_dir, "documents")).drop("perplexity")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.tampered_round_trip(table(spark, sf_dir, "documents"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_labels(license_scan.license_spans(table(spark, sf_dir, "documents")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_planted_periods(table(spark, sf_dir, "documents"))
    return periodic_runs.run_digests(periodic_runs.periodic_runs(docs))


QUERIES = {
    "op1_extendible_shards": op1_extendible_shards,
    "op2_rule_ensemble": op2_rule_ensemble,
    "op3_factorization": op3_factorization,
    "op4_site_tree": op4_site_tree,
    "op5_line_cleaning": op5_line_cleaning,
    "op6_entropy_mixing": op6_entropy_mixing,
    "op7_group_join": op7_group_join,
    "op8_zip_warc": op8_zip_warc,
    "op9_positional_index": op9_positional_index,
    "op10_class_lm": op10_class_lm,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_license_scan": op12_license_scan,
    "op13_periodic_runs": op13_periodic_runs,
}
