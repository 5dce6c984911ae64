"""The thin registered queries of the numbered operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm.common import load
from tidegauge.llm import archives, decontamination, lengths, merkle, mixing, quality, ranking, secrets, simhash, tokenfiles, topk, toxicity
from tidegauge.llm.dedup import near_duplicates


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(load(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predictions(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings(load(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op5_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archives.round_trip(load(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.round_trip(load(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.context_table(lengths.length_histogram(load(spark, sf_dir, "documents")))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(load(spark, sf_dir, "embeddings"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_fingerprints(load(spark, sf_dir, "documents"))


def op12_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(load(spark, sf_dir, "documents"), merkle.tampered_leaf())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_quality, op3_secrets, op4_toxicity, op5_archives, op6_decontamination, op7_token_files, op8_token_counts, op9_topk, op10_minhash, op11_simhash, op12_ranking, op13_merkle)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.ORACLE, "op5_archives": archives.ORACLE, "op6_decontamination": decontamination.ORACLE, "op9_topk": topk.ORACLE, "op12_ranking": ranking.ORACLE, "op13_merkle": merkle.ORACLE}
