"""Whitening of embeddings: principal components of distinct quantised vectors.

Vectors are quantised to whole numbers, so that sums and distances from the mean
are exact. Two passes over the distinct vectors give the sums and the centred
covariance; its largest components come from contour integration
(``plumbline.llm.feast``), and a third pass measures what whitening with them
leaves of the covariance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.common import materialize, ship
from plumbline.llm.feast import Contour, largest_eigenpairs

STEPS = 64  # of one unit
SHIFT = 1_000_000  # the same for all numbers: no difference from a mean knows it
_SAFE = 1 << 61


@dataclass(frozen=True)
class Model:
    """``n`` vectors with ``sums``; the components' eigenvalues and unit vectors (columns), falling.

    ``sums`` are those of the whole numbers before ``SHIFT`` is added.
    ``identity_error`` is the largest absolute entry of the whitened vectors'
    covariance minus the identity, null without components.
    """

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None

    @property
    def explained(self) -> list[float]:
        return [float(v) / self.trace for v in self.values]


def quantised(vector: Column) -> Column:
    """Whole numbers of a vector, without ``SHIFT``; beyond 64 bits the nearest that fits."""
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(c * STEPS).cast("bigint"))


def usable(vector: Column) -> Column:
    """Whether a vector is not null and holds finite entries only."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def fit(vectors: DataFrame, components: int = 16, contour: Contour = Contour(), vector_column: str = "embedding") -> Model | None:
    """The model of the distinct quantised vectors, each counted once.

    Vectors that are null or hold null or non-finite entries take no part. All
    others should be equally long; where they are not, the most frequent length
    counts (of equally frequent ones the larger), and the rest takes no part.
    Without any vector there is no model. Fewer components than asked for come
    out if the vectors have no more directions. Only sums, of the square of the
    dimensions at most, reach the driver.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(vector_column).cast("array<double>").alias("v")).where(usable(F.col("v")))
    rows = rows.select(quantised(F.col("v")).alias("x")).where("size(x) > 0")
    fit_list = materialize(rows.distinct())
    lengths = rows.groupBy(F.size("x").alias("d")).count()
    usual = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    if usual is None:
        return None
    d = usual["d"]
    fit_list = fit_list.where(F.size("x") == d)
    n, sums = _sums(fit_list, d)
    covariance = _gram(fit_list, d, _centred(n, sums)) / n
    values, axes = largest_eigenpairs(covariance, min(components, d), contour)
    error = None
    if len(values):
        white = _gram(fit_list, len(values), _whitened(n, sums, values, axes)) / n
        error = float(np.abs(white - np.eye(len(values))).max())
    return Model(n, sums, values, axes, float(np.trace(covariance)), error)


def whiten(
    vectors: DataFrame, model: Model | None, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """Rows (id, deviation, whitened), one for every vector that a model can be fitted on.

    ``whitened`` holds the centred vector's projections on the components, over
    the roots of their eigenvalues. ``deviation`` is the exact sum over the
    dimensions of (n * x - sum)^2; null if that is beyond 64 bits. Vectors of
    another length than the model's are left out, as are all without a model.
    Repeated rows get equal answers, null ids stay null; other columns are ignored.
    """
    schema = "id bigint, deviation bigint, whitened array<double>"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_column)
    ship(vectors.sparkSession)
    rows = vectors.select(
        F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).cast("array<double>").alias("v")
    ).where(usable(F.col("v")))
    rows = rows.select("id", quantised(F.col("v")).alias("x")).where(F.size("x") == len(model.sums))
    project = _whitened(model.n, model.sums, model.values, model.vectors)
    n, sums = model.n, model.sums

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"), len(sums))
                answers = pa.array(list(project(x)), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(_deviations(x, n, sums), pa.int64()), answers],
                    names=["id", "deviation", "whitened"],
                )

    return rows.mapInArrow(answer, schema).withColumnRenamed("id", id_column)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            n += len(x)
            # In two halves, neither of which a batch can carry beyond 64 bits.
            high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
            total = [t + (h << 32) + l for t, h, l in zip(total, high, low)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(d + 1), pa.int32()), pa.array([Decimal(t) for t in [n, *total]], pa.decimal128(38, 0))],
            names=["place", "total"],
        )

    summed = rows.mapInArrow(add, "place int, total decimal(38,0)").groupBy("place").agg(F.sum("total").alias("total"))
    totals = {r["place"]: int(r["total"]) for r in summed.collect()}
    return totals[0], [totals[i + 1] for i in range(d)]


def _centred(n: int, sums: list[int]):
    """Vectors less their mean: the whole part exactly, then the fraction."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    fraction = np.array([s % n / n for s in sums])

    def centre(x: np.ndarray) -> np.ndarray:
        if max(int(x.max(initial=0)), -int(x.min(initial=0))) < _SAFE and np.abs(whole).max() < _SAFE:
            return (x - whole).astype(np.float64) - fraction
        return x.astype(np.float64) - whole.astype(np.float64) - fraction

    return centre


def _whitened(n: int, sums: list[int], values: np.ndarray, axes: np.ndarray):
    centre, scaled = _centred(n, sums), axes / np.sqrt(values)
    return lambda x: centre(x) @ scaled


def _gram(rows: DataFrame, size: int, use) -> np.ndarray:
    """The sum over all vectors of ``use(x)`` times its transpose, row by row of the result."""
    schema = "place int, part array<double>"

    def rows_of(table: np.ndarray, places: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(places, pa.int32()), pa.array(list(table), pa.list_(pa.float64()))], names=["place", "part"]
        )

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                column = batch.column("x")
                y = use(_matrix(column, len(column[0])))
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield rows_of(total, list(range(size)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for place, part in zip(batch.column("place").to_pylist(), _matrix(batch.column("part"), size)):
                sums[place] = sums[place] + part if place in sums else part
        yield rows_of(np.array(list(sums.values())).reshape(-1, size), list(sums))

    parts = rows.mapInArrow(multiply, schema)
    out = np.zeros((size, size))
    for place, part in parts.repartition("place").mapInArrow(add, schema).collect():
        out[place] = part
    return out


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The exact sums of (n * x - sum)^2 of some vectors."""
    largest = max(int(x.max(initial=0)), -int(x.min(initial=0))) * n + max(abs(s) for s in sums)
    if largest < _SAFE:
        apart = x * n - np.array(sums, dtype=np.int64)
        if len(sums) * max(int(apart.max(initial=0)), -int(apart.min(initial=0))) ** 2 < _SAFE:
            return (apart * apart).sum(axis=1).tolist()
    found = (sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist())
    return [f if f < 1 << 63 else None for f in found]
