"""Parquet tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of `folder`, by Spark's own reader, so that any Hadoop path works."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
