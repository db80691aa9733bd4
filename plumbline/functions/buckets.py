"""Order-preserving buckets for work that needs a whole column in order.

Exact quantiles, running totals over values and steps between neighbours all
need order, and a window without a partition would put the column in one task.
``OrderedBuckets`` cuts a numeric column into a bounded number of consecutive
ranges instead. Totals per range then form a small table, and only the rows of
the ranges that matter have to be brought together and sorted.

The cut points come from one approximate-quantile pass. They decide only how
even the ranges are: any cut points give the same results. The number of coarse
ranges grows with the table up to a fixed bound, and each is divided evenly
once more by arithmetic.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.columns import col, present

ROWS_PER_RANGE = 1_000_000
MOST_RANGES = 4096
FINE = 16


@dataclass(frozen=True)
class OrderedBuckets:
    """Consecutive value ranges of some numeric columns.

    By default at most ``MOST_RANGES * FINE`` buckets per column and one range
    more at either end, whatever the number of rows: a table of one row per bucket takes a few megabytes and may be
    broadcast, or ordered in one task.
    """

    cuts: dict[str, list[float]]
    fine: int = FINE

    @classmethod
    def fit(
        cls,
        df: DataFrame,
        columns: Sequence[str],
        coarse: int | None = None,
        fine: int | None = FINE,
    ) -> OrderedBuckets:
        """Choose the cut points. Counts the rows and sketches the given columns.

        With ``fine=None`` as many buckets as the bound allows are made.
        """
        if coarse is None:
            coarse = min(max(df.count() // ROWS_PER_RANGE, 8), MOST_RANGES)
        if fine is None:
            fine = MOST_RANGES * FINE // coarse
        places = [f"value_{i}" for i in range(len(columns))]
        numbers = df.select(*[_as_double(df, c).alias(p) for c, p in zip(columns, places)])
        shares = [i / coarse for i in range(coarse + 1)]
        error = max(min(1e-3, 1 / (4 * coarse)), 1e-4)
        found = numbers.approxQuantile(places, shares, error)
        cuts = {}
        for name, values in zip(columns, found):
            finite = sorted({v for v in values if math.isfinite(v)})
            cuts[name] = [-math.inf, *(finite or [0.0]), math.inf]
        return cls(cuts, fine)

    def long_form(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """One row per present value: the kept columns, ``column``, ``bucket``, ``value``.

        One branch per column, so that each reads only what it needs and its
        generated code stays small enough to be compiled.
        """
        branches = [self._placed(df, name, keep) for name in self.cuts]
        return reduce(lambda a, b: a.unionByName(b), branches)

    def _placed(self, df: DataFrame, name: str, keep: Sequence[str]) -> DataFrame:
        cuts = self.cuts[name]
        from pyspark.ml.feature import Bucketizer  # brings pandas along, which most checks do without

        values = df.select(*[col(k) for k in keep], _as_double(df, name).alias("value")).where(
            F.col("value").isNotNull()
        )
        ranged = Bucketizer(splits=cuts, inputCol="value", outputCol="range").transform(values)
        low = F.get(_array(cuts[:-1]), F.col("range").cast("int"))
        scale = F.get(
            _array([self.fine / (b - a) for a, b in zip(cuts, cuts[1:])]),
            F.col("range").cast("int"),
        )
        # Subtracting and scaling by a positive constant keep order under
        # rounding, so a larger value never gets a smaller bucket. The
        # unbounded end ranges give 0 or NaN, and least() puts NaN on top.
        step = F.floor(
            F.least((F.col("value") - low) * scale, F.lit(float(self.fine - 1)))
        )
        # Never NULL, and coalesce() says so: otherwise a join on the bucket
        # would compute it once more to filter on.
        bucket = F.coalesce(F.col("range").cast("bigint") * self.fine + step, F.lit(-1))
        return ranged.select(
            *[col(k) for k in keep],
            F.lit(name).alias("column"),
            bucket.alias("bucket"),
            F.col("value"),
        )


def _as_double(df: DataFrame, name: str) -> Column:
    return present(df, name).cast("double")


def _array(numbers: Sequence[float]) -> Column:
    # Parsed at one go: a literal per element would be a JVM call each.
    return F.expr("array(" + ", ".join(f"double('{x!r}')" for x in numbers) + ")")
