"""Queries of the training-data operators over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from presswork.llm.common import read_table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from presswork.llm.secrets import secrets_report

    return secrets_report(read_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from presswork.llm.substring_dedup import substring_report

    return substring_report(read_table(spark, sf_dir, "documents"))


def op3_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from presswork.llm.mixing import mixing_report

    return mixing_report(read_table(spark, sf_dir, "documents"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from presswork.llm.fingerprints import fingerprint_report

    return fingerprint_report(read_table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from presswork.llm.ngram_join import ngram_report

    return ngram_report(read_table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from presswork.llm.licenses import license_report

    return license_report(read_table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from presswork.llm.decontaminate import contamination_report

    return contamination_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from presswork.llm.language_id import language_report

    return language_report(read_table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from presswork.llm.suffix_dedup import suffix_report

    return suffix_report(read_table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from presswork.llm.pii import pii_report

    return pii_report(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_secret_scan,
        op2_substring_dedup,
        op3_weighted_mix,
        op4_document_fingerprints,
        op5_ngram_join,
        op6_license_scan,
        op7_decontaminate,
        op8_language_id,
        op9_suffix_dedup,
        op10_pii,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from presswork.llm.decontaminate import CONTAMINATION_SQL
    from presswork.llm.mixing import MIXING_SQL
    from presswork.llm.ngram_join import NGRAM_SQL
    from presswork.llm.substring_dedup import SUBSTRING_SQL
    from presswork.llm.suffix_dedup import SUFFIX_SQL

    return {"op9_suffix_dedup": SUFFIX_SQL, "op5_ngram_join": NGRAM_SQL, "op2_substring_dedup": SUBSTRING_SQL, "op3_weighted_mix": MIXING_SQL, "op7_decontaminate": CONTAMINATION_SQL}
