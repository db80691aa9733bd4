"""Writing and reading back the findings of a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FINDING_SCHEMA = "check string, subject string, metric string, value double"


def write_report(findings: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write findings as parquet, one folder per check.

    A report has a few rows per column, rule or edge, so one file per check is
    enough; the repartition keeps every task from writing one of its own.
    """
    findings.repartition("check").write.partitionBy("check").mode(mode).parquet(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Read a written report; a filter on ``check`` reads only its folder."""
    return spark.read.schema(FINDING_SCHEMA).parquet(path).select(
        "check", "subject", "metric", "value"
    )
