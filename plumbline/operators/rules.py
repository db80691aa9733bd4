"""Rule check: how many rows break each named rule."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.columns import batches, none_of


def rule_check(df: DataFrame, rules: Mapping[str, str | Column]) -> DataFrame:
    """One row per rule: ``rule``, ``rows``, ``violations`` and ``unknown``.

    A rule is a boolean expression that should hold for every row. A row on
    which it is NULL neither keeps nor breaks the rule and counts as
    ``unknown``. Up to 40 rules are counted in one pass, without a shuffle of rows.
    Without a rule there are no rows.
    """
    if not rules:
        return none_of(df, "rule string, rows bigint, violations bigint, unknown bigint")
    parts = [_counted(df, part) for part in batches(list(rules.items()), 40)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _counted(df: DataFrame, rules: Sequence[tuple[str, str | Column]]) -> DataFrame:
    holds = [F.expr(rule) if isinstance(rule, str) else rule for _, rule in rules]
    counts = [F.count("*").alias("rows")]
    for i, rule in enumerate(holds):
        counts += [
            F.count_if(~rule).alias(f"violations_{i}"),
            F.count_if(rule.isNull()).alias(f"unknown_{i}"),
        ]
    entries = [
        F.struct(
            F.lit(name).alias("rule"),
            F.col("rows"),
            F.col(f"violations_{i}").alias("violations"),
            F.col(f"unknown_{i}").alias("unknown"),
        )
        for i, (name, _) in enumerate(rules)
    ]
    return df.agg(*counts).select(F.inline(F.array(*entries)))
