"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fim, jaccard, language, licenses, merkle, mixing, pii, ppm, quality, secrets, tokens, topk
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_languages(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_query(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_pseudonymise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise_texts(table(spark, sf_dir, "documents"), pii.KEY)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_text_tokens(table(spark, sf_dir, "documents"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_texts(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_manifest(table(spark, sf_dir, "documents"))


def op12_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.transform_digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_mix_sources, op3_decontaminate, op4_pseudonymise, op5_token_counts, op6_exact_topk, op7_license_scan, op8_jaccard_join, op9_lm_score, op10_secret_scan, op11_merkle_manifest, op12_quality_score, op13_fill_in_middle)}


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_sources": mixing.MIXING_SQL, "op3_decontaminate": decontaminate.DECONTAMINATION_SQL, "op6_exact_topk": topk.TOPK_SQL, "op7_license_scan": licenses.LICENSES_SQL, "op8_jaccard_join": jaccard.JACCARD_SQL, "op11_merkle_manifest": merkle.MERKLE_SQL, "op13_fill_in_middle": fim.FIM_SQL}
