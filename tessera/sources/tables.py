"""Parquet table access with column pruning left to Catalyst."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """Read one table.

    ``spread`` marks sources with heavy work on each row before the first shuffle.  They are dealt
    out anew only if ``tessera.scan.spread`` asks for a number of partitions: useful where a source
    is one small file, a needless shuffle where it is many.
    """
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    parts = int(spark.conf.get("tessera.scan.spread", "0")) if spread else 0
    return df.repartition(parts) if parts else df
