"""The Parquet tables that jobs read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table `name` of a folder; any path that Spark's readers open."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
