"""Reference check: child rows whose parent does not exist."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.columns import col


@dataclass(frozen=True)
class Edge:
    """``child`` columns that have to occur as ``parent`` columns."""

    child: str
    child_keys: tuple[str, ...]
    parent: str
    parent_keys: tuple[str, ...]

    def __post_init__(self):
        if len(self.child_keys) != len(self.parent_keys):
            raise ValueError("an edge needs as many parent keys as child keys")

    @property
    def name(self) -> str:
        return f"{self.child}({','.join(self.child_keys)})->{self.parent}"


def orphan_keys(
    child: DataFrame, child_keys: Sequence[str], parent: DataFrame, parent_keys: Sequence[str]
) -> DataFrame:
    """The child keys without a parent, with their number of child rows ``n``.

    A key with a missing part refers to nothing and is no orphan.
    """
    used = _used_keys(child, child_keys)
    complete = used.where(_complete(len(child_keys)))
    known = _known_keys(parent, parent_keys)
    return complete.join(known, _places(len(child_keys)), "left_anti").select(
        *[F.col(p).alias(name) for p, name in zip(_places(len(child_keys)), child_keys)], "n"
    )


def reference_check(
    child: DataFrame, child_keys: Sequence[str], parent: DataFrame, parent_keys: Sequence[str]
) -> DataFrame:
    """One row: ``child_rows``, ``unset_rows``, ``orphan_keys`` and ``orphan_rows``.

    Both sides are reduced to distinct keys before they meet. The join then has
    at most one row per key on either side, however many rows share a key, and
    it uses the partitioning that counting the keys has already made.
    """
    used = _used_keys(child, child_keys)
    known = _known_keys(parent, parent_keys).withColumn("known", F.lit(True))
    orphan = F.col("known").isNull() & _complete(len(child_keys))
    zero = F.lit(0).cast("bigint")
    return used.join(known, _places(len(child_keys)), "left").agg(
        F.coalesce(F.sum("n"), zero).alias("child_rows"),
        F.coalesce(F.sum(F.when(~_complete(len(child_keys)), F.col("n"))), zero).alias(
            "unset_rows"
        ),
        F.count_if(orphan).alias("orphan_keys"),
        F.coalesce(F.sum(F.when(orphan, F.col("n"))), zero).alias("orphan_rows"),
    )


def reference_summary(tables: Mapping[str, DataFrame], edges: Sequence[Edge]) -> DataFrame:
    """``reference_check`` for every edge, one row each, named in ``edge``."""
    checks = [
        reference_check(tables[e.child], e.child_keys, tables[e.parent], e.parent_keys).select(
            F.lit(e.name).alias("edge"), "*"
        )
        for e in edges
    ]
    return reduce(lambda a, b: a.unionByName(b), checks)


def _places(width: int) -> list[str]:
    return [f"key_{i}" for i in range(width)]


def _complete(width: int) -> Column:
    return reduce(lambda a, b: a & b, [F.col(p).isNotNull() for p in _places(width)])


def _named_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*[col(k).alias(p) for k, p in zip(keys, _places(len(keys)))])


def _used_keys(child: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _named_keys(child, keys).groupBy(*_places(len(keys))).agg(F.count("*").alias("n"))


def _known_keys(parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _named_keys(parent, keys).where(_complete(len(keys))).distinct()
