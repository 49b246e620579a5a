"""The driver's tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .shipping import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; filters and columns reach its scan."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
