"""N-gram Jaccard join: near-duplicate documents by rare-first prefix filtering.

Sets of word shingles are put into one global order, rare ones first. Two sets
of Jaccard similarity ``t`` or more must share a shingle within their first few
ones, so only these are joined. Length and position of a match rule out most of
what meets by chance, a suffix filter and then the exact count do the rest.

Any total order gives the same links. The order follows a table of counts per
hash bucket over all documents, which has a fixed size, and then the hash.

Copies and clusters of near copies are kept from meeting in all pairs:

* documents with equal sets are one class, joined once;
* the first merging round verifies each class against a few common members per
  shared shingle only, and links what is similar; the next ones deal the members
  of crowded shingles to small buckets and try the pairs of a bucket, as long as
  that links more;
* the last join takes every remaining pair that shares a prefix shingle, but
  only between classes that are not connected yet. A link inside a component
  would not change it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.common import few_rows, materialize, materialize_from_texts, maybe_in, ship
from plumbline.llm.components import connected_components
from plumbline.llm.shingles import mix, shingle_sets

COUNTERS = 1 << 22  # of the table that orders shingles, 16 MB
PART = 1 << 16  # counters in a row on their way to the sum
TOKEN_BITS = 48
SIGNATURE = ("s0", "s1", "s2", "s3")  # 256 bits of each set
CENTERS = 8  # so many members of each shingle are tried in the first merging round
CROWD = 64  # so many in the others


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words; linked when 100 * common >= ``percent`` * union."""

    words: int = 5
    percent: int = 80

    def least_overlap(self, a, b):
        return -(-self.percent * (a + b) // (100 + self.percent))

    def probing(self, n: int) -> int:
        """Length of the prefix that meets the prefixes of smaller sets."""
        return n - -(-self.percent * n // 100) + 1

    def indexed(self, n: int) -> int:
        """Length of the prefix that larger sets have to meet."""
        return n - -(-2 * self.percent * n // (100 + self.percent)) + 1

    def possible(self) -> Column:
        """Length, position and suffix filter for columns n, pos and fold of a and b.

        Two sets differ in as many shingles at least as their signatures in bits,
        folded or not.

        True for the first shingle, in the global order, that two linked sets share.
        """
        return F.expr(
            f"100L * least(n_a, n_b) >= {self.percent}L * greatest(n_a, n_b) AND "
            f"{100 + self.percent}L * least(n_a - pos_a, n_b - pos_b) >= {self.percent}L * (n_a + n_b) AND "
            f"bit_count(fold_a ^ fold_b) <= {self._differences()}"
        )

    def alike(self) -> str:
        """The suffix filter on whole signatures, for columns n and s0 to s3 of a and b."""
        bits = " + ".join(f"bit_count({c}_a ^ {c}_b)" for c in SIGNATURE)
        return f"{bits} <= {self._differences()}"

    def _differences(self) -> str:
        return f"n_a + n_b - 2 * (({self.percent}L * (n_a + n_b) + {99 + self.percent}L) div {100 + self.percent}L)"


def near_duplicates(
    docs: DataFrame, rule: Rule = Rule(), id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Rows (id, ``n_shingles``, ``component_id``), one for every row of ``docs``.

    ``component_id`` is the smallest id reachable by links, itself included.
    Null and wordless texts have no shingles and are linked with nothing. Equal
    texts, tokens apart from white space and A-Z case, are linked. A null id
    takes part as any other, but it can't be a component id: a component is
    named after its smallest known id, and is null if there is none. Rows that
    share an id are one document with several texts. Other columns are ignored.
    """
    ship(docs.sparkSession)
    texts = docs.select(
        F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text")
    )
    sets, grades = _sets_and_grades(texts, rule)
    # Key, size and signature are 350 bits of what makes a class.
    identity = ["key", "n", *SIGNATURE]
    classes = (
        sets.where("n > 0 AND id IS NOT NULL").groupBy(*identity).agg(F.min("id").alias("rep"))
    )
    classes = materialize(classes.withColumn("fold", F.expr(" ^ ".join(SIGNATURE))))
    joined = _joined_prefixes(texts, grades, rule, classes)
    components = _components(texts, joined, rule, classes)
    # Documents of one class may carry an id that stands elsewhere as well.
    labelled = (
        sets.join(classes.select(*identity, "rep"), identity, "left")
        .join(components, F.col("rep") == F.col("node"), "left")
        .select(
            "id", "n", F.coalesce("component", F.when(F.col("n") > 0, F.col("rep")), "id").alias("component_id")
        )
    )
    return labelled.select(
        F.col("id").alias(id_column), F.col("n").cast("bigint").alias("n_shingles"), "component_id"
    )


def _sets_and_grades(texts: DataFrame, rule: Rule) -> tuple[DataFrame, np.ndarray]:
    """One row per document with its class key and set size; frequencies of shingles by bucket."""
    names = ["id", "key", "n", *SIGNATURE, "part", "counts"]
    schema = "id bigint, key bigint, n int, s0 bigint, s1 bigint, s2 bigint, s3 bigint, part int, counts binary"

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.uint32)
        for batch in few_rows(batches):
            keys, sizes, waiting, signatures = [], [], [], []
            for found in shingle_sets(batch.column("text").to_pylist(), rule.words):
                sizes.append(len(found))
                keys.append(_class_key(found))
                waiting.append(_bucket(found))
                signatures.append(_signature(found))
            np.add.at(total, np.concatenate([np.zeros(0, np.int64), *waiting]), np.uint32(1))
            nothing = [pa.nulls(len(keys), pa.int32()), pa.nulls(len(keys), pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(keys, pa.int64()),
                    pa.array(sizes, pa.int32()),
                    *[pa.array(c, pa.int64()) for c in zip(*signatures)],
                    *nothing,
                ],
                names=names,
            )
        parts = [i for i in range(COUNTERS // PART) if total[i * PART : (i + 1) * PART].any()]
        counts = [pa.compress(total[i * PART : (i + 1) * PART].tobytes(), "zstd", asbytes=True) for i in parts]
        none = [pa.nulls(len(parts), kind) for kind in (pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4)]
        yield pa.RecordBatch.from_arrays(
            [*none, pa.array(parts, pa.int32()), pa.array(counts, pa.binary())], names=names
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # At most COUNTERS / PART sums for each task, whatever its input.
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts")):
                found = np.frombuffer(pa.decompress(counts.as_buffer(), 4 * PART, "zstd"), dtype=np.uint32)
                sums[part] = sums[part] + found if part in sums else found.astype(np.uint64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([_grade(x).tobytes() for x in sums.values()], pa.binary())],
            names=["part", "counts"],
        )

    both = materialize_from_texts(
        texts.mapInArrow(summarize, schema)
    )
    parts = both.where("part IS NOT NULL").select("part", "counts")
    total = np.zeros(COUNTERS, dtype=np.uint16)
    summed = parts.repartition(COUNTERS // PART, "part").mapInArrow(add, "part int, counts binary")
    for part, counts in summed.collect():
        total[part * PART : (part + 1) * PART] = np.frombuffer(counts, dtype=np.uint16)
    return both.where("part IS NULL").select("id", "key", "n", *SIGNATURE), total


def _signature(found: np.ndarray) -> list[int]:
    """For each of 256 parts of all shingles whether the set holds an odd number of it."""
    odd = np.bincount(((found >> np.uint64(20)) & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _grade(counts: np.ndarray) -> np.ndarray:
    """Frequencies in steps of a hundredth of a doubling."""
    return np.round(np.log2(counts.astype(float) + 1) * 100).astype(np.uint16)


def _class_key(found: np.ndarray) -> int:
    """A 64-bit digest of a set."""
    place = np.arange(1, len(found) + 1, dtype=np.uint64)
    digest = mix(np.array([np.sum(mix(found + place)) ^ np.uint64(len(found))], dtype=np.uint64))
    return int(digest.view(np.int64)[0])


def _bucket(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def _joined_prefixes(
    texts: DataFrame, grades: np.ndarray, rule: Rule, classes: DataFrame
) -> DataFrame:
    """Rows (token, rep, n, pos, fold, crowded, indexed) of the prefix shingles that two classes or more share."""

    low = np.uint64((1 << TOKEN_BITS) - 1)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            tokens, keys, sizes, places = [], [], [], []
            for found in shingle_sets(batch.column("text").to_pylist(), rule.words):
                if not len(found):
                    continue
                # The frequency above the hash in one number.
                grade = grades[_bucket(found)].astype(np.uint64) << np.uint64(TOKEN_BITS)
                ranked = np.sort(grade | (found & low))[: rule.probing(len(found))]
                tokens.append((ranked & low).astype(np.int64))
                keys.append(np.full(len(ranked), _class_key(found)))
                sizes.append(np.full(len(ranked), len(found), dtype=np.int32))
                places.append(np.arange(len(ranked), dtype=np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in (tokens, keys, sizes, places)],
                    names=["token", "key", "n", "pos"],
                )

    rows = texts.where("id IS NOT NULL").mapInArrow(prefixes, "token bigint, key bigint, n int, pos int")
    # Copies send the same rows; size and place are packed to keep the shuffle narrow.
    rows = rows.where("token IS NOT NULL AND key IS NOT NULL")
    packed = rows.select("token", "key", F.expr("coalesce(n * 4294967296L + pos, -1L)").alias("place")).distinct()
    # A place that can't be null and an inner join keep both readers of the rows
    # alike, so that they share one shuffle.
    shared = packed.groupBy("token").agg(F.count("*").alias("members")).where("members > 1")
    known = classes.select("key", F.col("n").alias("size"), "rep", "fold")
    share = 2 * rule.percent
    return materialize_from_texts(
        packed.join(shared, "token")
        .join(known, "key")
        .where("shiftright(place, 32) = size")
        .select(
            "token",
            "rep",
            F.shiftright("place", 32).cast("int").alias("n"),
            F.expr("cast(place & 4294967295L as int)").alias("pos"),
            "fold",
            (F.col("members") > CROWD).alias("crowded"),
        )
        .withColumn("indexed", F.expr(f"pos < n - (({share} * n + {99 + rule.percent}) div {100 + rule.percent}) + 1"))
    )


def _components(texts: DataFrame, joined: DataFrame, rule: Rule, classes: DataFrame) -> DataFrame:
    """Rows (node, component) of the classes that are linked with another."""
    found = materialize_from_texts(_verify(texts, materialize(_alike(_star_pairs(joined, rule), classes, rule)), rule))
    tried, links = found.select("a", "b"), found.where("linked").select("a", "b")
    components = None if links.isEmpty() else connected_components(links)
    crowd = materialize(joined.where("crowded").join(classes.select("rep", *SIGNATURE), "rep"))
    turn, few = 0, None
    while not (rows := materialize(_open_rows(crowd, components).where(F.col("members") > CROWD))).isEmpty():
        if few is None:  # the texts of crowds, so that later turns need not read all texts
            few = materialize(texts.where(maybe_in(rows.select(F.xxhash64("rep")))(F.xxhash64("id"))))
        pairs = materialize(_signed_pairs(_bucketed(rows, turn), rule).join(tried, ["a", "b"], "left_anti"))
        found = materialize_from_texts(_compared(few, pairs, rule))
        tried = tried.unionByName(found.select("a", "b"))
        now = found.where("linked").select("a", "b")
        if fresh_links := now.count():
            components = _extended(components, now)
        # Another turn is worth its jobs if this one has linked some of the crowd,
        # and not so many that hardly anything of it can be left apart.
        crowded = rows.select("rep").distinct().count()
        if not crowded <= 50 * fresh_links < 75 * crowded:
            break
        turn += 1
    rows = materialize(_open_rows(joined, components))
    crowd = rows.where(F.col("members") > CROWD).join(classes.select("rep", *SIGNATURE), "rep")
    several = _alike(_pairs(rows.where(F.col("members") <= CROWD), rule), classes, rule)
    pairs = _signed_pairs(crowd, rule).unionByName(several).distinct()
    found = materialize_from_texts(_verify(texts, materialize(pairs.join(tried, ["a", "b"], "left_anti")), rule))
    now = found.where("linked").select("a", "b")
    if not now.isEmpty():
        components = _extended(components, now)
    return _known(texts, components)


def _extended(components: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components with more links: each one known counts as one link a node, whatever it grew from."""
    if components is not None:
        links = links.unionByName(components.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return connected_components(links)


def _known(texts: DataFrame, components: DataFrame | None) -> DataFrame:
    if components is None:
        return texts.select(F.col("id").alias("node"), F.col("id").alias("component")).limit(0)
    return components


def _open_rows(joined: DataFrame, components: DataFrame | None) -> DataFrame:
    """The rows of shingles that stand in several components, with their number.

    What lies within one component has nothing left to find.
    """
    rows = joined.withColumn("component", F.col("rep"))
    if components is not None:
        rows = joined.join(components, joined["rep"] == components["node"], "left").select(
            joined["*"], F.coalesce("component", "rep").alias("component")
        )
    open_ = (
        rows.groupBy("token")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members"))
        .where("low != high")
    )
    return rows.join(open_.select("token", "members"), "token")


def _bucketed(rows: DataFrame, turn: int) -> DataFrame:
    """The rows with their shingle's members dealt to buckets of ``CROWD``, other ones each turn.

    Near copies share many shingles, so most pairs of a cluster meet in some of
    their buckets; each row meets a bounded number of others, however large the
    cluster is.
    """
    bucket = F.pmod(F.xxhash64("rep", "token", F.lit(turn)), F.ceil(F.col("members") / CROWD))
    return rows.withColumn("token", F.xxhash64("token", bucket))


def _star_pairs(rows: DataFrame, rule: Rule) -> DataFrame:
    """Each class with a few of the classes that share a shingle with it.

    These few come first among the shingle's members in as many hash orders of
    all classes. The orders are the same for all shingles, so that near copies,
    which share many, mostly meet the same ones.
    """
    orders = [F.hash("rep", F.lit(i)) for i in range(CENTERS)]
    members = rows.select("token", "rep", "n", "pos", "fold")
    least = rows.groupBy("token").agg(*[F.min(order).alias(f"least_{i}") for i, order in enumerate(orders)])
    first = reduce(or_, [order == F.col(f"least_{i}") for i, order in enumerate(orders)])
    centers = members.join(least, "token").where(first).select(
        "token", *[F.col(c).alias(f"{c}_a") for c in members.columns if c != "token"]
    )
    pairs = (
        members.select("token", *[F.col(c).alias(f"{c}_b") for c in members.columns if c != "token"])
        .join(centers, "token")
        .where("rep_a != rep_b")
        .withColumns({"small": F.col("rep_a"), "large": F.col("rep_b")})
    )
    return _distinct_pairs(pairs.where(rule.possible()))


def _pairs(rows: DataFrame, rule: Rule, carried: tuple[str, ...] = ("fold",), more: str = "true") -> DataFrame:
    """Every pair of unconnected classes that share a token and pass the filters."""

    def side(name: str) -> DataFrame:
        columns = ("rep", "n", "pos", "component", "indexed", *carried)
        return rows.select("token", *[F.col(c).alias(f"{c}_{name}") for c in columns])

    smaller = F.expr("component_a != component_b AND (n_a < n_b OR (n_a = n_b AND rep_a < rep_b))")
    met = side("a").where("indexed_a").join(side("b"), "token").where(smaller & rule.possible() & F.expr(more))
    return _distinct_pairs(met.select(F.col("rep_a").alias("small"), F.col("rep_b").alias("large")))


def _signed_pairs(rows: DataFrame, rule: Rule) -> DataFrame:
    """The same for rows with whole signatures, whose test then is part of the join.

    Crowds of like texts give far more pairs than can be linked; they never leave it.
    """
    return _pairs(rows, rule, ("fold", *SIGNATURE), rule.alike())


def _distinct_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("small", "large").alias("a"), F.greatest("small", "large").alias("b")).distinct()


def _alike(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose whole signatures allow a link."""

    def side(name: str) -> DataFrame:
        return classes.select(
            F.col("rep").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("n", *SIGNATURE)]
        )

    return pairs.join(side("a"), "a").join(side("b"), "b").where(rule.alike()).select("a", "b")


def _verify(texts: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """Rows (a, b, linked): each pair's sets compared once, from the whole texts."""
    wanted = maybe_in(pairs.select(F.explode(F.array(F.xxhash64("a"), F.xxhash64("b")))))
    return _compared(texts.where(wanted(F.xxhash64("id"))), pairs, rule)


def _compared(few: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """The same for texts of which most are wanted."""
    met = (
        pairs.join(few.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        .join(few.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            left = shingle_sets(batch.column("text_a").to_pylist(), rule.words)
            right = shingle_sets(batch.column("text_b").to_pylist(), rule.words)
            linked = [_similar(x, y, rule) for x, y in zip(left, right)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"]
            )

    return (
        met.mapInArrow(compare, "a bigint, b bigint, linked boolean")
        .groupBy("a", "b")
        .agg(F.max("linked").alias("linked"))
    )


_PIVOTS = np.arange(1, 32, dtype=np.uint64) * np.uint64(1 << 59)


def _similar(x: np.ndarray, y: np.ndarray, rule: Rule) -> bool:
    if not len(x) or not len(y):
        return False
    least = rule.least_overlap(len(x), len(y))
    if min(len(x), len(y)) < least:
        return False
    # Suffix filter: pivots cut both sets alike; parts of unlike size can't be common.
    cuts = [np.diff(np.searchsorted(s, _PIVOTS), prepend=0, append=len(s)) for s in (x, y)]
    if np.abs(cuts[0] - cuts[1]).sum() > len(x) + len(y) - 2 * least:
        return False
    return len(np.intersect1d(x, y, assume_unique=True)) >= least
