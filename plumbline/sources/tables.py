"""Reading the tables to be checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a folder that holds ``<name>.parquet`` per table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
