"""Exact quantiles of whole columns without sorting them."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.columns import batches, col, number_columns, present

ROWS_PER_TASK = 2_000_000
SKETCH_ERROR = 1e-3


@dataclass(frozen=True)
class _Interval:
    """The closed value range that holds one wanted quantile of one column."""

    column: int
    share: float
    low_rank: int
    high_rank: int
    part: float
    low: float
    high: float
    before: int
    upto: int
    between: int  # rows strictly between low and high

    def holds(self) -> bool:
        return self.before <= self.low_rank and self.high_rank < self.upto


def quantiles(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    shares: Sequence[float] = (0.25, 0.5, 0.75),
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Interpolated quantiles: one row (``column``, ``share``, ``value``) each.

    Linear interpolation between neighbouring values, as SQL ``percentile``
    does. NULL and NaN are left out; a column without values gives no row.

    The built-in ``percentile`` keeps every distinct value of a column in one
    buffer. Here a column with more than ``rows_per_task`` values is first
    narrowed to a value range around each wanted rank: a sketch proposes the
    range and an exact count confirms it, both without a shuffle, so the few
    remaining rows can be sorted whatever the size of the table. These passes
    run when the function is called and bring a few numbers per column back.
    """
    columns = number_columns(df, columns)
    places = [f"value_{i}" for i in range(len(columns))]
    numbers = df.select(
        *[present(df, c).cast("double").alias(p) for c, p in zip(columns, places)]
    )
    totals = numbers.agg(*[F.count(p).alias(p) for p in places]).first()
    intervals = [
        _whole(i, float(share), total)
        for i, total in enumerate(totals)
        if total
        for share in shares
    ]
    narrowed = _narrow(numbers, intervals, rows_per_task)
    return _pick(df, columns, narrowed)


def _whole(column: int, share: float, total: int) -> _Interval:
    position = share * (total - 1)
    low_rank = math.floor(position)
    return _Interval(
        column,
        share,
        low_rank,
        min(low_rank + 1, total - 1),
        position - low_rank,
        -math.inf,
        math.inf,
        0,
        total,
        total,
    )


def _narrow(
    numbers: DataFrame, intervals: Sequence[_Interval], rows_per_task: int
) -> list[_Interval]:
    done = [i for i in intervals if i.between <= rows_per_task]
    wide = [i for i in intervals if i.between > rows_per_task]
    while wide:
        tried = _confirm(numbers, _propose(numbers, wide), wide)
        # Equal values cannot be told apart further, so give up on a range
        # that no longer shrinks: sorting it is slower but as right.
        done += [
            new
            for old, new in zip(wide, tried)
            if new.between <= rows_per_task or new.between > old.between / 2
        ]
        wide = [i for i in tried if i not in done]
    return done


def _value(interval: _Interval) -> Column:
    return F.col(f"value_{interval.column}")


def _propose(numbers: DataFrame, wide: Sequence[_Interval]) -> list[tuple[float, float]]:
    """Value ranges that hold the wanted ranks, going by a sketch."""
    margin = 2 * SKETCH_ERROR
    ends = []
    for i in wide:
        inside = i.upto - i.before
        ends.append(
            (
                (i.low_rank - i.before) / inside - margin,
                (i.high_rank + 1 - i.before) / inside + margin,
            )
        )
    asked = sorted({e for pair in ends for e in pair if 0 < e < 1})
    if not asked:
        return [(i.low, i.high) for i in wide]
    # Quantiles of several intervals of one column come from one sketch.
    ranges = list(dict.fromkeys((i.column, i.low, i.high) for i in wide))
    inside = numbers.select(
        *[
            F.when(F.col(f"value_{column}").between(low, high), F.col(f"value_{column}")).alias(
                f"range_{j}"
            )
            for j, (column, low, high) in enumerate(ranges)
        ]
    )
    names = [f"range_{j}" for j in range(len(ranges))]
    found = dict(zip(ranges, inside.approxQuantile(names, asked, SKETCH_ERROR)))
    proposed = []
    for i, (start, stop) in zip(wide, ends):
        sketch = dict(zip(asked, found[(i.column, i.low, i.high)]))
        proposed.append((sketch.get(start, i.low), sketch.get(stop, i.high)))
    return proposed


def _confirm(
    numbers: DataFrame, proposed: Sequence[tuple[float, float]], wide: Sequence[_Interval]
) -> list[_Interval]:
    """Count the proposed ranges exactly; keep the old range where a rank is outside."""
    asked = list(zip(range(len(wide)), proposed, wide))
    branches = []
    for column in sorted({i.column for i in wide}):
        of_column = [a for a in asked if a[2].column == column]
        branches += [_count(numbers, part) for part in batches(of_column, 24)]
    counted = {r["place"]: r for r in reduce(lambda a, b: a.unionByName(b), branches).collect()}
    confirmed = []
    for j, ((low, high), i) in enumerate(zip(proposed, wide)):
        new = _Interval(
            i.column,
            i.share,
            i.low_rank,
            i.high_rank,
            i.part,
            low,
            high,
            counted[j]["before"],
            counted[j]["upto"],
            counted[j]["between"],
        )
        confirmed.append(new if new.holds() else i)
    return confirmed


def _count(numbers: DataFrame, asked: Sequence[tuple]) -> DataFrame:
    """Rows below, up to the end of, and strictly between each proposed range."""
    counts, entries = [], []
    for j, (low, high), interval in asked:
        value = _value(interval)
        counts += [
            F.count_if(value < low).alias(f"before_{j}"),
            F.count_if(value <= high).alias(f"upto_{j}"),
            F.count_if((value > low) & (value < high)).alias(f"between_{j}"),
        ]
        entries.append(
            F.struct(
                F.lit(j).alias("place"),
                F.col(f"before_{j}").alias("before"),
                F.col(f"upto_{j}").alias("upto"),
                F.col(f"between_{j}").alias("between"),
            )
        )
    return numbers.agg(*counts).select(F.inline(F.array(*entries)))


def _pick(df: DataFrame, columns: Sequence[str], intervals: Sequence[_Interval]) -> DataFrame:
    # Intervals with the same range share their rows.
    ranges = list(dict.fromkeys((i.column, i.low, i.high) for i in intervals))
    branches = [
        _near(df, name, [(j, *r[1:]) for j, r in enumerate(ranges) if r[0] == column])
        for column, name in enumerate(columns)
    ]
    in_range = Window.partitionBy("range")
    counted = (
        reduce(lambda a, b: a.unionByName(b), branches)
        .groupBy("range", "value")
        .agg(F.count("*").alias("n"))
        .withColumn("last", F.sum("n").over(in_range.orderBy("value")))
        .withColumn("first", F.col("last") - F.col("n"))
    )

    # What is wanted of each range: constants, looked up by its number.
    wanted = [[i for i in intervals if (i.column, i.low, i.high) == r] for r in ranges]
    slots = max(map(len, wanted), default=0)

    def constant(slot: int, of: Callable[[_Interval], object]) -> Column:
        values = [of(w[slot]) if slot < len(w) else None for w in wanted]
        return F.get(F.array(*[F.lit(v) for v in values]), F.col("range"))

    def value_at(rank: Column) -> Column:
        hit = (rank >= F.col("first")) & (rank < F.col("last"))
        return F.max(F.when(hit, F.col("value")))

    facts, entries = [], []
    for k in range(slots):
        facts += [
            value_at(constant(k, lambda i: i.low_rank - i.before)).alias(f"low_{k}"),
            value_at(constant(k, lambda i: i.high_rank - i.before)).alias(f"high_{k}"),
        ]
        entries.append(
            F.struct(
                constant(k, lambda i: columns[i.column]).alias("column"),
                constant(k, lambda i: i.share).alias("share"),
                constant(k, lambda i: i.part).alias("part"),
                F.col(f"low_{k}").alias("low"),
                F.col(f"high_{k}").alias("high"),
            )
        )
    if not slots:
        return df.sparkSession.createDataFrame([], "column string, share double, value double")
    between = F.when(
        (F.col("part") == 0) | (F.col("low") == F.col("high")), F.col("low")
    ).otherwise((1 - F.col("part")) * F.col("low") + F.col("part") * F.col("high"))
    # The aggregate uses the partitioning of the window.
    return (
        counted.groupBy("range")
        .agg(*facts)
        .select(F.inline(F.array(*entries)))
        .where(F.col("share").isNotNull())
        .select("column", "share", between.alias("value"))
    )


def _near(df: DataFrame, name: str, ranges: Sequence[tuple[int, float, float]]) -> DataFrame:
    """The values of a column within any of the numbered ranges, once for each.

    A branch per column, so that the scan gets the ranges as its own filter.
    NaN is beyond infinity and thus in none.
    """
    number = col(name).cast("double")
    inside = {j: number.between(low, high) for j, low, high in ranges}
    if len(ranges) == 1:
        place = F.lit(ranges[0][0])
    else:
        hits = [F.when(hit, F.lit(j)) for j, hit in inside.items()]
        place = F.explode(F.array_compact(F.array(*hits).cast("array<int>")))
    return df.where(reduce(lambda a, b: a | b, inside.values(), F.lit(False))).select(
        place.alias("range"), number.alias("value")
    )
