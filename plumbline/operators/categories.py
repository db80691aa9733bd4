"""Categorical comparison of groups: shares, total variation, chi-square."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.columns import col, present


SALTS = 64


def category_shares(df: DataFrame, level: str, group: str) -> DataFrame:
    """Rows (``level``, ``group``, ``n``, ``share``) for the pairs that occur.

    ``share`` is the part of the group's rows that have the level. Rows where
    either is missing are left out.
    """
    counts = (
        _pairs(df, level, group).groupBy("level", "group").agg(F.count("*").alias("n"))
    )
    totals = counts.groupBy("group").agg(F.sum("n").alias("total"))
    # A group may have nearly all levels: it is dealt out by level as well.
    salts = F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)"))
    salted = totals.select("group", "total", salts.alias("salt"))
    counts = counts.withColumn("salt", F.pmod(F.xxhash64("level"), F.lit(SALTS)))
    return counts.join(salted, ["group", "salt"]).select(
        "level", "group", "n", (F.col("n") / F.col("total")).alias("share")
    )


def category_levels(df: DataFrame, level: str, group: str, first, second) -> DataFrame:
    """Both groups side by side: ``level``, counts, shares and their difference.

    A level that only one group has gets 0 for the other.
    """
    counts = _side_by_side(df, level, group, first, second)
    share_first = F.try_divide("n_first", _total(counts, "n_first"))
    share_second = F.try_divide("n_second", _total(counts, "n_second"))
    return counts.select(
        "level",
        "n_first",
        "n_second",
        share_first.alias("share_first"),
        share_second.alias("share_second"),
        (share_first - share_second).alias("difference"),
    )


def category_distance(df: DataFrame, level: str, group: str, first, second) -> DataFrame:
    """One row on how far the levels of two groups are apart.

    ``levels``, ``n_first``, ``n_second``, ``total_variation`` (half the summed
    share differences), ``chi_square`` of the two-column table of counts and
    its ``degrees``. The distances are NULL if a group has no row.
    """
    counts = _side_by_side(df, level, group, first, second)
    total_first, total_second = _total(counts, "n_first"), _total(counts, "n_second")
    # The totals are scalar subqueries: they reach the tasks as two numbers.
    known = counts.withColumns({"total_first": total_first, "total_second": total_second})
    row_total = F.col("n_first") + F.col("n_second")
    all_rows = F.col("total_first") + F.col("total_second")

    def excess(n: str, total: str) -> Column:
        expected = row_total * F.try_divide(total, all_rows)
        return F.try_divide((F.col(n) - expected) ** 2, expected)

    share_gap = F.abs(
        F.try_divide("n_first", "total_first") - F.try_divide("n_second", "total_second")
    )
    both = (F.sum("n_first") > 0) & (F.sum("n_second") > 0)
    chi_square = F.sum(excess("n_first", "total_first") + excess("n_second", "total_second"))
    zero = F.lit(0).cast("bigint")
    return known.agg(
        F.count("*").alias("levels"),
        F.coalesce(F.sum("n_first"), zero).alias("n_first"),
        F.coalesce(F.sum("n_second"), zero).alias("n_second"),
        F.when(both, F.sum(share_gap) / 2).alias("total_variation"),
        F.when(both, chi_square).alias("chi_square"),
        F.when(both, F.count("*") - 1).alias("degrees"),
    )


def _pairs(df: DataFrame, level: str, group: str) -> DataFrame:
    return df.select(present(df, level).alias("level"), col(group).alias("group")).where(
        F.col("level").isNotNull() & F.col("group").isNotNull()
    )


def _side_by_side(df: DataFrame, level: str, group: str, first, second) -> DataFrame:
    return (
        _pairs(df, level, group)
        .where(F.col("group").isin(first, second))
        .groupBy("level")
        .agg(
            F.count_if(F.col("group") == first).alias("n_first"),
            F.count_if(F.col("group") == second).alias("n_second"),
        )
    )


def _total(counts: DataFrame, column: str) -> Column:
    return counts.agg(F.sum(column)).scalar()
