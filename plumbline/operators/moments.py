"""Moments of numeric columns and correlations between them."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.columns import batches, col, none_of, number_columns, present

TOGETHER = 8  # pairs of columns in one aggregate


def moments(
    df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Per column: ``n``, ``mean``, ``sd``, ``skewness`` and ``kurtosis``.

    ``sd`` is the sample standard deviation. Skewness and excess kurtosis are
    the population ones, without the small-sample correction. With ``by``, one
    row per group and column; each task sends one row per group it has seen.
    Without a numeric column there are no rows.
    """
    columns = [c for c in number_columns(df, columns) if c not in by]
    if not columns:
        facts = [F.lit(None).cast("double").alias(f) for f in ("mean", "sd", "skewness", "kurtosis")]
        names = [F.lit("").alias("column"), F.lit(0).cast("bigint").alias("n")]
        return df.select(*[col(b) for b in by], *names, *facts).limit(0)
    parts = [_moments(df, part, by) for part in batches(columns, 6)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _moments(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    facts = []
    for i, name in enumerate(columns):
        value = present(df, name).cast("double")
        facts += [
            F.count(value).alias(f"n_{i}"),
            F.avg(value).alias(f"mean_{i}"),
            F.stddev_samp(value).alias(f"sd_{i}"),
            F.skewness(value).alias(f"skewness_{i}"),
            F.kurtosis(value).alias(f"kurtosis_{i}"),
        ]
    entries = [
        F.struct(
            F.lit(name).alias("column"),
            *[
                F.col(f"{fact}_{i}").alias(fact)
                for fact in ("n", "mean", "sd", "skewness", "kurtosis")
            ],
        )
        for i, name in enumerate(columns)
    ]
    grouped = df.groupBy(*[col(b) for b in by]).agg(*facts)
    return grouped.select(*[col(b) for b in by], F.inline(F.array(*entries)))


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair: ``left``, ``right``, ``n``, ``correlation``.

    A row counts for a pair if both values are present. The correlation with a
    constant is NULL. A few pairs are aggregates side by side, ``TOGETHER`` in a
    pass. Of more columns all pairs share one pass: a row is looked at once for
    every ``TOGETHER`` pairs, and each task sends one row for these. Without a
    pair there are no rows.
    """
    names = number_columns(df, columns)
    pairs = list(combinations(range(len(names)), 2))
    if not pairs:
        return none_of(df, "left string, right string, n bigint, correlation double")
    if len(pairs) <= 4 * TOGETHER:
        parts = [_few_correlations(df, [(names[i], names[j]) for i, j in part]) for part in batches(pairs, TOGETHER)]
        return reduce(lambda a, b: a.unionByName(b), parts)
    return _many_correlations(df, names, pairs)


def _correlation(x: Column, y: Column) -> Column:
    """The built-in corr() fails on a constant column in ANSI mode."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def _few_correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    facts, entries = [], []
    for i, (left, right) in enumerate(pairs):
        x, y = present(df, left).cast("double"), present(df, right).cast("double")
        x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
        facts += [F.count(x).alias(f"n_{i}"), _correlation(x, y).alias(f"correlation_{i}")]
        entries.append(
            F.struct(
                F.lit(left).alias("left"),
                F.lit(right).alias("right"),
                F.col(f"n_{i}").alias("n"),
                F.col(f"correlation_{i}").alias("correlation"),
            )
        )
    return df.agg(*facts).select(F.inline(F.array(*entries)))


def _many_correlations(df: DataFrame, names: Sequence[str], pairs: Sequence[tuple[int, int]]) -> DataFrame:
    groups = [
        {"group": i, "left": [p[0] for p in part], "right": [p[1] for p in part]}
        for i, part in enumerate(batches(pairs, TOGETHER))
    ]
    # One literal, however many pairs there are.
    listed = F.from_json(F.lit(json.dumps(groups)), "array<struct<group: int, left: array<int>, right: array<int>>>")
    values = F.array(*[present(df, name).cast("double") for name in names])
    rows = df.select(values.alias("values"), F.inline(listed))
    facts = []
    for i in range(TOGETHER):
        x, y = (F.get("values", F.get(side, F.lit(i))) for side in ("left", "right"))
        x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
        facts += [F.count(x).alias(f"n_{i}"), _correlation(x, y).alias(f"correlation_{i}")]
    found = rows.groupBy("group").agg(*facts)
    every = df.sparkSession.range(1).select(F.inline(listed)).join(found, "group", "left")
    named = F.array(*[F.lit(name) for name in names])
    entries = [
        F.struct(
            F.get(named, F.get("left", F.lit(i))).alias("left"),
            F.get(named, F.get("right", F.lit(i))).alias("right"),
            F.coalesce(f"n_{i}", F.lit(0)).alias("n"),
            F.col(f"correlation_{i}").alias("correlation"),
        )
        for i in range(TOGETHER)
    ]
    return every.select(F.inline(F.array(*entries))).where("left IS NOT NULL")
