"""Registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tessera.llm import (
    context_mixing, decontaminate, langid, license_rules, line_dedup, merkle, mixing, quality_rules, simhash, token_rollup, toxicity,
    warc_zstd, whitening,
)
from tessera.llm.common import shared_path, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zstd.report(table(spark, sf_dir, "pages"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollup.report(table(spark, sf_dir, "documents"), shared_path(spark, "token-rollup"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.report(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op11_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.report(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(table(spark, sf_dir, "embeddings"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(table(spark, sf_dir, "documents"))


_QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_toxicity, op3_warc, op4_decontaminate, op5_simhash, op6_token_rollup, op7_mixing, op8_langid,
    op9_licenses, op10_line_dedup, op11_context_mixing,
    op12_whitening, op13_merkle)} | {"pipeline": corpus_pipeline.run}

_ORACLES = {"op1_quality_rules": quality_rules.oracle(), "op4_decontaminate": decontaminate.oracle(),
            "op9_licenses": license_rules.oracle(), "op13_merkle": merkle.oracle()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
