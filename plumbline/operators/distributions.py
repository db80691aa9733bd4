"""Numeric comparison of two groups: the two-sample KS statistic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.buckets import OrderedBuckets
from plumbline.functions.columns import col, number_columns


def ks_statistics(
    df: DataFrame, columns: Sequence[str] | None, group: str, first, second
) -> DataFrame:
    """Largest difference of the cumulative shares of two groups, per column.

    Rows (``column``, ``n_first``, ``n_second``, ``statistic``). NULL and NaN
    are left out; the statistic is NULL if a group has no value.

    The counts of ordered buckets give the difference at every bucket end, and
    for each bucket a bound that no value inside can exceed. Only buckets whose
    bound reaches the best difference at an end are looked into, so two groups
    that differ visibly need hardly any rows shuffled, and any others are
    spread over all buckets that may decide.
    """
    columns = number_columns(df, columns)
    rows = df.where(col(group).isin(first, second)).select(
        *[col(c) for c in columns],
        (col(group) == first).cast("int").alias("is_first"),
    )
    # The smaller the buckets, the tighter their bounds, the fewer are opened.
    buckets = OrderedBuckets.fit(rows, columns, fine=None)
    values = buckets.long_form(rows, keep=["is_first"])
    by_group = [
        F.sum("is_first").alias("n_first"),
        F.sum(1 - F.col("is_first")).alias("n_second"),
    ]

    # A bounded number of rows per column, see OrderedBuckets.
    in_column = Window.partitionBy("column")
    ends = (
        values.groupBy("column", "bucket")
        .agg(*by_group)
        .withColumns(
            {
                "upto_first": F.sum("n_first").over(in_column.orderBy("bucket")),
                "upto_second": F.sum("n_second").over(in_column.orderBy("bucket")),
                "total_first": F.sum("n_first").over(in_column),
                "total_second": F.sum("n_second").over(in_column),
            }
        )
        .withColumns(
            {
                "before_first": F.col("upto_first") - F.col("n_first"),
                "before_second": F.col("upto_second") - F.col("n_second"),
            }
        )
        .withColumn("known", F.abs(_share("upto_first") - _share("upto_second")))
        .withColumn("best", F.max("known").over(in_column))
        .withColumn(
            "bound",
            F.greatest(
                _share("upto_first") - _share("before_second"),
                _share("upto_second") - _share("before_first"),
            ),
        )
    )
    # The bucket with the best end is always among them. Where a group has no
    # value there is no bound, and the last bucket is kept for the totals.
    is_last = (F.col("upto_first") == F.col("total_first")) & (
        F.col("upto_second") == F.col("total_second")
    )
    is_open = F.coalesce(F.col("bound") >= F.col("best"), is_last)
    open_buckets = ends.where(is_open).select(
        "column", "bucket", "before_first", "before_second", "total_first", "total_second"
    )

    # One row per bucket at most, so both broadcasts are bounded.
    in_bucket = Window.partitionBy("column", "bucket").orderBy("value")
    inside = (
        values.join(
            open_buckets.select("column", "bucket"), ["column", "bucket"], "left_semi"
        )
        .groupBy("column", "bucket", "value")
        .agg(*by_group)
        .withColumns(
            {
                "inside_first": F.sum("n_first").over(in_bucket),
                "inside_second": F.sum("n_second").over(in_bucket),
            }
        )
        .join(open_buckets, ["column", "bucket"])
        .withColumns(
            {
                "upto_first": F.col("before_first") + F.col("inside_first"),
                "upto_second": F.col("before_second") + F.col("inside_second"),
            }
        )
        .withColumn("known", F.abs(_share("upto_first") - _share("upto_second")))
    )
    # A column without any value has no bucket, but gets its row.
    zero = F.lit(0).cast("bigint")
    nothing = df.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(c) for c in columns])).alias("column"),
        zero.alias("total_first"),
        zero.alias("total_second"),
        F.lit(None).cast("double").alias("known"),
    )
    return (
        inside.select(nothing.columns)
        .unionByName(nothing)
        .groupBy("column")
        .agg(
            F.max("total_first").alias("n_first"),
            F.max("total_second").alias("n_second"),
            F.max("known").alias("statistic"),
        )
    )


def _share(count: str) -> Column:
    return F.try_divide(count, "total_first" if count.endswith("first") else "total_second")
