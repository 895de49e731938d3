"""Reading of the catalogue's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table of a data directory; only the columns used downstream reach the scan."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
