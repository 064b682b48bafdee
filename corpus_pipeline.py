"""Corpus pipeline: from raw documents to rated training documents.

Each stage takes (spark, docs, sf_dir), with ``docs`` what the stage before it
kept, and works on all of it.  All but the last return the columns of
``documents``; the last adds each document's tokens, domain posterior, domain
and rate.

Cases: null and empty texts go with the first stage, which wants ten words; null
ids, sources and languages stay; repeated rows are near duplicates of each other,
so one stays; different texts under one id stay apart; very long texts are taken
whole; other columns, whatever their names, come through the first four stages (of
those that the last stage adds, its own are returned); an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, line_dedup, mixing, quality_rules, simhash
from tessera.llm.common import cut, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines above the host limits; rejected documents go."""
    return quality_rules.clean(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the earliest of equal and near-equal lines; documents left without a word go."""
    return line_dedup.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class stays."""
    return simhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rates every document so that the domains' expected tokens meet their targets."""
    return mixing.mix(docs, mixing.label_domains(table(spark, sf_dir, "labels")), mixing.TARGETS)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash_dedup", near_duplicates),
          ("benchmark_decontamination", benchmark), ("source_mixing", mixture)]

#: SimHash, edit distances and fitted rates are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
