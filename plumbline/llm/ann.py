"""Approximate nearest neighbours with a forest of random-projection trees.

Each tree halves the space again and again by a hyperplane between two random
vectors. All vectors are indexed: they go to their leaf of every tree. A query
walks all trees through one priority queue, nearest leaves first, until it has
met enough vectors; those are then ranked exactly.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.llm.common import materialize, ship

if TYPE_CHECKING:
    import pandas as pd

COPIES_SALT = 16


@dataclass(frozen=True)
class Forest:
    """``trees`` trees, fitted on ``sample`` vectors at most, with about 1 / ``leaf`` leaves.

    A leaf has the share ``leaf`` of the sample at most, 32 vectors at least.
    The sample bounds the model, not the index. Each query looks at leaves that
    hold ``meet`` times as many entries together as there are vectors, and
    ``least`` at least; vectors that it meets in several trees count each time.
    Directions without any structure, as in the given tables, need a large share
    for a recall of 0.9; clustered ones far less. A leaf of more than
    ``rows_per_part`` vectors is searched in parts, and so are its queries if
    there are more than ``queries_per_part`` of them in all.
    """

    trees: int = 8
    sample: int = 65_536
    leaf: float = 1 / 64
    meet: float = 1.2
    least: int = 2_000
    rows_per_part: int = 20_000
    queries_per_part: int = 20_000
    seed: int = 7


@dataclass
class Tree:
    """Inner nodes: hyperplane, offset and two children; a child below 0 is leaf -1 - child."""

    planes: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    leaves: int


def nearest(
    vectors: DataFrame,
    k: int = 20,
    queries: Column | None = None,
    forest: Forest = Forest(),
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """Rows (query_id, rank, id, score): for each query the nearest other vectors found.

    Nearness is the inner product in double precision; ranks start at 1, ties go
    to the smaller id. ``queries`` is a condition on ``vectors``, by default an
    id divisible by 20. Vectors that are null, zero, or that hold a null or
    non-finite component take no part, nor do null ids. All others should be
    equally long; where they are not, only those of the most frequent length take
    part (of equally frequent ones the shorter). Of rows that repeat an id the
    smallest vector counts. An empty table, or a
    single vector, gives no rows; other columns are ignored.
    """
    ship(vectors.sparkSession)
    condition = F.expr(f"`{id_column}` % 20 = 0") if queries is None else queries
    rows = vectors.select(
        F.col(id_column).cast("bigint").alias("id"),
        F.col(vector_column).cast("array<double>").alias("v"),
        condition.alias("asked"),
    ).where(
        "id IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
        " AND exists(v, x -> x != 0)"
    )
    once = rows.groupBy("id").agg(F.min("v").alias("v"), F.max("asked").alias("asked"))
    lengths = once.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"))
    usual = lengths.orderBy(F.desc("rows"), "n").first()
    schema = "query_id bigint, rank int, id bigint, score double"
    if usual is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_column)
    table = materialize(once.where(F.size("v") == usual["n"]))
    trees, reach = _fit(table, usual["rows"], float(np.sqrt(usual["norm"])), forest)
    # Of equal vectors only the k + 1 smallest ids can be among a query's k nearest;
    # they are found by parts, so that one frequent vector is no single group.
    part = F.pmod(F.xxhash64("id"), F.lit(COPIES_SALT))
    copies = Window.partitionBy("v", part).orderBy("id")
    indexed = table.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1)
    located = materialize(
        indexed.select("id", "v").mapInArrow(_leaves_of(trees, reach), "id bigint, v array<double>, leaf bigint")
    )
    sizes = {r["leaf"]: r["count"] for r in located.groupBy("leaf").count().collect()}
    parts = {leaf: -(-n // forest.rows_per_part) for leaf, n in sizes.items() if n > forest.rows_per_part}
    asked = table.where("asked").select("id", "v").mapInArrow(
        _visits(trees, sizes, parts, max(forest.least, int(forest.meet * usual["rows"]))), "query bigint, q array<double>, leaf bigint, part int"
    )
    many = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair]) if parts else None
    piece = F.lit(0) if many is None else F.pmod(F.xxhash64("id"), F.coalesce(many[F.col("leaf")], F.lit(1))).cast("int")
    # Any leaf may be asked by all queries: these are dealt too, and meet their own copy of the leaf.
    salts = -(-table.where("asked").count() // forest.queries_per_part) or 1
    salted = asked.withColumn("salt", F.pmod(F.xxhash64("query"), F.lit(salts)).cast("int"))
    copied = located.withColumn("part", piece).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    found = (
        copied.groupBy("leaf", "part", "salt")
        .cogroup(salted.groupBy("leaf", "part", "salt"))
        .applyInPandas(_best_of_leaf(k), "query bigint, id bigint, score double")
    )
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    best = (
        found.groupBy("query", "id")
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )
    return best.select(F.col("query").alias("query_id"), "rank", F.col("id").alias(id_column), "score")


def _fit(table: DataFrame, rows: int, reach: float, forest: Forest) -> tuple[list[Tree], float]:
    """Trees over a bounded sample, those of the smallest hash of their id."""
    share = min(1.0, 1.2 * forest.sample / max(rows, 1))
    near = table.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int(share * (1 << 40)) + 1)
    collected = near.select("id", "v").limit(forest.sample).toPandas().sort_values("id")
    sample = _lifted(np.array(collected["v"].tolist(), dtype=np.float64), reach)
    random = np.random.default_rng(forest.seed)
    leaf = max(32, int(len(sample) * forest.leaf))
    return [_grow(sample, leaf, random) for _ in range(forest.trees)], reach


def _lifted(vectors: np.ndarray, reach: float) -> np.ndarray:
    """One more component that makes all vectors equally long: then the largest
    inner product with a query, lifted by 0, is the smallest angle."""
    rest = np.maximum(reach * reach - (vectors * vectors).sum(axis=1), 0)
    return np.column_stack([vectors, np.sqrt(rest)])


def _grow(sample: np.ndarray, leaf: int, random: np.random.Generator) -> Tree:
    planes, offsets, children = [], [], []
    leaves = 0
    todo: list[tuple[np.ndarray, int, int]] = [(np.arange(len(sample)), -1, 0)]
    while todo:
        members, parent, side = todo.pop()
        split = None
        for _ in range(4 if len(members) > leaf else 0):
            a, b = sample[random.choice(members, 2, replace=False)]
            if not (a == b).all():
                plane = (a - b) / np.linalg.norm(a - b)
                values = sample[members] @ plane
                offset = float(np.median(values))
                if 0 < (values <= offset).sum() < len(members):
                    split = plane, offset, values <= offset
                    break
        if split is None:
            place = -1 - leaves
            leaves += 1
        else:
            place = len(planes)
            planes.append(split[0])
            offsets.append(split[1])
            children.append([0, 0])
            todo.append((members[~split[2]], place, 1))
            todo.append((members[split[2]], place, 0))
        if parent >= 0:
            children[parent][side] = place
    width = sample.shape[1]
    return Tree(
        np.array(planes).reshape(-1, width), np.array(offsets), np.array(children, dtype=np.int64).reshape(-1, 2), leaves
    )


def _leaves_of(trees: list[Tree], reach: float):
    """Every vector with its leaf of each tree, for mapInArrow."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lifted = _lifted(_matrix(batch.column("v")), reach)
            for t, tree in enumerate(trees):
                at = np.zeros(len(lifted), dtype=np.int64) if len(tree.planes) else np.full(len(lifted), -1)
                while (inner := np.flatnonzero(at >= 0)).size:
                    node = at[inner]
                    side = (lifted[inner] * tree.planes[node]).sum(axis=1) > tree.offsets[node]
                    at[inner] = tree.children[node, side.astype(int)]
                leaf = pa.array((t << 32) + (-1 - at))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), leaf], names=["id", "v", "leaf"])

    return locate


def _visits(trees: list[Tree], sizes: dict[int, int], parts: dict[int, int], meet: int):
    """The leaves that each query visits, for mapInArrow."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, leaves, pieces = [], [], []
            matrix = _matrix(batch.column("v"))
            lifted = np.column_stack([matrix, np.zeros(len(matrix))])
            for i, query in enumerate(lifted):
                for leaf in _walk(trees, query, sizes, meet):
                    for piece in range(parts.get(leaf, 1)):
                        rows.append(i)
                        leaves.append(leaf)
                        pieces.append(piece)
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(taken), batch.column("v").take(taken), pa.array(leaves, pa.int64()), pa.array(pieces, pa.int32())],
                names=["query", "q", "leaf", "part"],
            )

    return visit


def _walk(trees: list[Tree], query: np.ndarray, sizes: dict[int, int], meet: int) -> Iterator[int]:
    """Leaves of all trees from the nearest on, until they hold ``meet`` vectors."""
    margins = [tree.planes @ query - tree.offsets for tree in trees]
    queue = [(0.0, t, 0 if len(tree.planes) else -1) for t, tree in enumerate(trees)]
    heapq.heapify(queue)
    met = 0
    while queue and met < meet:
        distance, t, node = heapq.heappop(queue)
        while node >= 0:
            margin = margins[t][node]
            near, far = trees[t].children[node][int(margin > 0)], trees[t].children[node][int(margin <= 0)]
            heapq.heappush(queue, (max(distance, abs(float(margin))), t, int(far)))
            node = int(near)
        leaf = (t << 32) + (-1 - node)
        if n := sizes.get(leaf):
            met += n
            yield leaf


def _best_of_leaf(k: int):
    """Exact scores of a leaf's vectors for its queries, the best of each query."""

    def best(members: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd

        if not len(members) or not len(asked):
            return pd.DataFrame({"query": [], "id": [], "score": []}).astype({"query": "int64", "id": "int64"})
        ids, vectors = members["id"].to_numpy(), np.stack(members["v"].to_numpy())
        wanted, questions = asked["query"].to_numpy(), np.stack(asked["q"].to_numpy())
        place = {int(x): i for i, x in enumerate(ids)}
        out = []
        for start in range(0, len(wanted), 256):
            some, asking = wanted[start : start + 256], questions[start : start + 256]
            rough = asking @ vectors.T
            for i, query in enumerate(some.tolist()):
                if query in place:
                    rough[i, place[query]] = -np.inf
            width = min(k + 1, len(ids))
            close = np.argpartition(rough, -width, axis=1)[:, -width:]
            values = np.sort(np.take_along_axis(rough, close, axis=1), axis=1)
            rows, columns = np.repeat(np.arange(len(some)), width), close.ravel()
            if width > k:
                # Where the last place is as good as tied, all that tie take part.
                for i in np.flatnonzero(values[:, 1] - values[:, 0] <= 1e-9 * np.maximum(1.0, np.abs(values[:, 1]))):
                    more = np.flatnonzero(rough[i] >= values[i, 1] - 1e-9 * max(1.0, abs(values[i, 1])))
                    rows, columns = np.append(rows, np.full(len(more), i)), np.append(columns, more)
            others = rough[rows, columns] > -np.inf
            rows, columns = rows[others], columns[others]
            # Summed alike for every pair, so that equal vectors tie exactly.
            scores = (vectors[columns] * asking[rows]).sum(axis=1)
            order = np.lexsort((ids[columns], -scores, rows))
            rows, columns, scores = rows[order], columns[order], scores[order]
            fresh = np.append(True, (rows[1:] != rows[:-1]) | (columns[1:] != columns[:-1])) if len(rows) else np.zeros(0, bool)
            rows, columns, scores = rows[fresh], columns[fresh], scores[fresh]
            first = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
            out.append((some[rows[first]], ids[columns[first]], scores[first]))
        return pd.DataFrame({name: np.concatenate([o[i] for o in out]) for i, name in enumerate(("query", "id", "score"))})

    return best


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
