"""Key check: keys that occur more than once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.columns import col, unused


def key_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys seen more than once, with their number of rows ``n``.

    Missing key values are equal to each other. Rows are counted before the
    shuffle, so a key that holds a large part of the table costs one row per
    task.
    """
    n = unused(df, "n")
    return _counts(df, keys, n).where(F.col(n) > 1).withColumnRenamed(n, "n")


def key_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: ``rows``, ``keys``, ``repeated_keys`` and ``surplus_rows``.

    ``surplus_rows`` is the number of rows to drop for the keys to be unique.
    """
    n = unused(df, "n")
    return (
        _counts(df, keys, n)
        .agg(
            F.coalesce(F.sum(n), F.lit(0)).alias("rows"),
            F.count("*").alias("keys"),
            F.count_if(F.col(n) > 1).alias("repeated_keys"),
        )
        .withColumn("surplus_rows", F.col("rows") - F.col("keys"))
    )


def _counts(df: DataFrame, keys: Sequence[str], n: str) -> DataFrame:
    return df.groupBy(*[col(k) for k in keys]).agg(F.count("*").alias(n))
