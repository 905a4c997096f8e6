"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; the path may be local or in any store that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
