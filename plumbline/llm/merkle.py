"""Merkle manifest of a dataset: digests of rows, hashed in runs up to one root.

The rows of each group are the leaves of a tree, in order; the trees' roots are
the leaves of the tree above them. On every level the first node of a run (slot
zero) is joined with its siblings: the one at slot offset ``k`` is the node whose
index less ``k`` is the first one's. Its row then holds the whole run and emits
the parent. Proofs go the other way: a parent's row hands its run and its own
path down to the members, so that a leaf gets its siblings of all levels while
only the much fewer rows of runs are moved.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.common import materialize, numbered

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before: string, after: string>>"


def digest_of(fields: Sequence[Column]) -> Column:
    """Hex SHA-256 of some values: ``-`` for a null, else the UTF-8 length, a colon and the value."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def joined_digest(digests: Column) -> Column:
    """Hex SHA-256 of an array of hex digests, put together as text."""
    return F.sha2(F.array_join(digests, "").cast("binary"), 256)


@dataclass(frozen=True)
class Manifest:
    """``rows``: the leaves, numbered by tree; ``runs`` and ``top``: the runs of nodes of each level from the leaves on.

    ``top`` are the runs of the tree above, whose leaves are the trees' roots in ``roots``.
    """

    rows: DataFrame
    runs: list[DataFrame]
    roots: DataFrame
    top: list[DataFrame]
    arity: int = 8

    def nodes(self) -> DataFrame:
        """Rows (tree, level, index, digest) of all nodes; the tree above has none for ``tree``."""
        found = self.rows.select("tree", F.lit(0).alias("level"), "index", "digest")
        for level, runs in enumerate(self.runs, 1):
            found = found.unionByName(runs.select("tree", F.lit(level).alias("level"), "index", "digest"))
        none = F.lit(None).cast("string").alias("tree")
        found = found.unionByName(self.roots.select(none, F.lit(0).alias("level"), "index", "digest"))
        for level, runs in enumerate(self.top, 1):
            found = found.unionByName(runs.select(none, F.lit(level).alias("level"), "index", "digest"))
        # Trees are numbered by a key that tells null from every text.
        return found.withColumn("tree", F.when(F.col("tree") != "-", F.substr("tree", F.lit(2))))

    def proofs(self) -> DataFrame:
        """The payload of every leaf with leaf, subroot, root and path, leaf to root.

        An element of the path holds the digests left and right of the node in
        its run, each side put together; a lone leaf has none for its tree.
        """
        empty = F.array().cast(PATH)
        start = self.top[-1] if self.top else self.roots
        above = start.select("tree", "index", F.col("digest").alias("root"), empty.alias("path"))
        for runs in reversed(self.top):
            above = _down(above, runs, ["root"])
        # Every row of the lowest level is now the root of a tree: its number leads to the tree.
        above = above.select("index", "root", "path").join(
            self.roots.select("index", F.col("key").alias("tree"), "n", F.col("digest").alias("subroot")), "index"
        )
        above = above.select("tree", F.lit(0).cast("bigint").alias("index"), "n", "root", "subroot", "path").withColumn(
            "depth", _depth(F.col("n"), len(self.runs), self.arity)
        )
        open_ = None
        for level in range(len(self.runs), 0, -1):
            begun = above.where(F.col("depth") == level).select("tree", "index", "root", "subroot", "path")
            open_ = begun if open_ is None else open_.unionByName(begun)
            open_ = _down(open_, self.runs[level - 1], ["root", "subroot"], leaves=level == 1)
        lone = above.where("depth = 0").join(self.rows.where("n = 1").select("tree", "payload"), "tree")
        lone = lone.select("root", "subroot", "path", "payload", F.col("subroot").alias("leaf"))
        if open_ is not None:
            lone = open_.select("root", "subroot", "path", "payload", F.col("digest").alias("leaf")).unionByName(lone)
        return lone.select("payload.*", "leaf", "subroot", "root", "path")


def _depth(n: Column, levels: int, arity: int) -> Column:
    """Levels of runs above ``n`` leaves: the least power of the arity that reaches ``n``."""
    found = F.lit(0)
    for level in range(levels):
        found = F.when(n > arity**level, level + 1).otherwise(found)
    return found


def _down(nodes: DataFrame, runs: DataFrame, kept: list[str], leaves: bool = False) -> DataFrame:
    """The members of each node's run, with the path of the node and their siblings before it."""
    met = nodes.join(runs.select("tree", "index", "members"), ["tree", "index"])
    each = met.select("tree", "index", *kept, "path", "members", F.posexplode("members").alias("slot", "member"))
    digests = F.col("members.digest")
    step = F.struct(
        F.array_join(F.slice(digests, F.lit(1), F.col("slot")), "").alias("before"),
        F.array_join(F.slice(digests, F.col("slot") + 2, F.size("members")), "").alias("after"),
    )
    return each.select(
        "tree",
        F.col("member.index").alias("index"),
        *([F.col("member.digest").alias("digest"), F.col("member.payload").alias("payload")] if leaves else []),
        *kept,
        F.concat(F.array(step), "path").alias("path"),
    )


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(
        path, leaf, lambda digest, step: F.sha2(F.concat(step["before"], digest, step["after"]).cast("binary"), 256)
    )


def proof_digest(path: Column) -> Column:
    """Hex SHA-256 of all siblings of a path, level by level, left to right."""
    siblings = F.transform(path, lambda step: F.concat(step["before"], step["after"]))
    return joined_digest(siblings)


def build(
    rows: DataFrame,
    digest: Column,
    group: Column,
    order: Column,
    payload: dict[str, Column],
    arity: int = 8,
) -> Manifest:
    """The manifest of ``rows``: one leaf each, and one tree for every value of ``group``.

    Leaves ascend by ``order``, nulls first, then by digest; while a level has
    several nodes, every ``arity`` consecutive ones (the last run: fewer, even
    one) become the digest of their digests. Roots of the trees, by group (null
    first, UTF-8 bytewise), are put into a tree likewise. ``payload`` is kept
    with each leaf. Equal rows are leaves side by side; any length of a value is
    digested whole; no rows give no nodes.

    Leaves are numbered by ranges of (group, order, digest), so that a group that
    holds most rows is spread over tasks. Runs jobs: every level is a written
    table, from which lost tasks are done again.
    """
    key = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))
    leaves = materialize(
        rows.select(
            key.alias("tree"),
            order.alias("place"),
            digest.alias("digest"),
            F.struct(*[c.alias(name) for name, c in payload.items()]).alias("payload"),
        )
    )
    placed = numbered(leaves, "tree", ["place", "digest"]).select("tree", "index", "n", "digest", "payload")
    runs, nodes = _levels(placed, arity, "payload")
    roots = numbered(
        nodes.select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("n").alias("leaves"), "digest"),
        "tree",
        ["key"],
    )
    top, _ = _levels(roots.select("tree", "index", "n", "digest"), arity)
    return Manifest(
        placed, runs, roots.select("tree", "index", "key", F.col("leaves").alias("n"), "digest"), top, arity
    )


def _levels(nodes: DataFrame, arity: int, *kept: str) -> tuple[list[DataFrame], DataFrame]:
    """The runs of every level from the leaves on, and the last node (tree, n of leaves, digest) of each tree."""
    leaves = nodes.select("tree", "index", "digest", "n", F.col("n").alias("leaves"), *kept)
    largest = nodes.agg(F.max("n")).first()[0] or 0
    level, runs, roots = leaves, [], []
    while largest > 1:
        roots.append(level.where("n = 1").select("tree", F.col("leaves").alias("n"), "digest"))
        runs.append(materialize(_parents(level.where("n > 1"), arity, kept)))
        level = runs[-1].select("tree", "index", "digest", "n", "leaves")
        largest, kept = -(-largest // arity), ()
    roots.append(level.where("n = 1").select("tree", F.col("leaves").alias("n"), "digest"))
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return runs, found


def _parents(nodes: DataFrame, arity: int, kept: Sequence[str]) -> DataFrame:
    """Rows (tree, index, n, leaves, members, digest): each run of nodes with its parent."""
    member = F.struct("index", "digest", *kept)
    slot = F.col("index") % arity
    run = nodes.where(slot == 0).select("tree", F.col("index").alias("first"), "n", "leaves", member.alias("member_0"))
    for k in range(1, arity):
        sibling = nodes.where(slot == k).select("tree", (F.col("index") - k).alias("first"), member.alias(f"member_{k}"))
        run = run.join(sibling, ["tree", "first"], "left")
    members = F.array_compact(F.array(*[f"member_{k}" for k in range(arity)]))
    return run.select(
        "tree",
        F.expr(f"first div {arity}").alias("index"),
        F.expr(f"(n + {arity - 1}) div {arity}").alias("n"),
        "leaves",
        members.alias("members"),
    ).withColumn("digest", joined_digest(F.col("members.digest")))
