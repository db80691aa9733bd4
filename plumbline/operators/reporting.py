"""All findings in one table: check, subject, metric, value."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.functions.columns import col, is_number


def findings(result: DataFrame, check: str, subject: str | Column) -> DataFrame:
    """A check's result as rows (``check``, ``subject``, ``metric``, ``value``).

    ``subject`` names what a row is about: a text, which then holds for all
    rows, or an expression over the result. Every numeric column becomes a
    metric; empty ones give no finding. Meant for results of a few rows per
    column, rule or edge, not for lists of keys.
    """
    subject = F.lit(subject) if isinstance(subject, str) else subject
    metrics = [f.name for f in result.schema.fields if is_number(f.dataType)]
    entries = [
        F.struct(F.lit(m).alias("metric"), col(m).cast("double").alias("value")) for m in metrics
    ]
    return (
        result.select(
            F.lit(check).alias("check"),
            subject.cast(T.StringType()).alias("subject"),
            F.array(*entries).alias("entries"),
        )
        .select("check", "subject", F.inline("entries"))
        .where(F.col("value").isNotNull())
    )


def report(parts: Sequence[DataFrame]) -> DataFrame:
    """The findings of several checks together."""
    return reduce(lambda a, b: a.unionByName(b), parts)
