"""URL rules by Bloom filter cascades.

A cascade holds a list of keys so that membership is exact for every key of a
given universe: the first filter has the listed keys, the second the unlisted
keys of the universe that the first lets through, the third the listed ones
that the second lets through, and so on until none is wrong. The universe is
every key that the corpus can ask for, so urls are judged without a join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.common import ascii_lower, materialize

MOST_BITS = 1 << 24  # of a filter, that is 2 MB


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the url's path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    seed: int
    words: tuple[int, ...]  # of 32 bits

    def passes(self, key: Column) -> Column:
        table = F.expr("array(" + ",".join(f"{w}L" for w in self.words) + ")")
        found = F.lit(True)
        for place in _places(key, self.bits, self.hashes, self.seed):
            word = F.get(table, F.shiftright(place, 5).cast("int"))
            bit = F.call_function("bit_get", word, place.bitwiseAND(F.lit(31)).cast("int"))
            found = found & (bit == 1)
        return found


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        verdict = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels))):
            # A miss of an even level means "not listed", of an odd one "listed".
            verdict = F.when(level.passes(key), verdict).otherwise(F.lit(i % 2 == 1))
        return verdict


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """The cascade of ``listed`` over ``universe``, both with a column ``key``.

    Null keys are left out. Sizes follow the list and the logarithm of the
    universe: the first filter lets through about as many unlisted keys as there
    are listed ones, the later ones half of what they see. A list that would
    need more than ``MOST_BITS`` at once is refused.
    """
    listed = materialize(listed.select("key").where("key IS NOT NULL").distinct())
    n = listed.count()
    if not n:
        return Cascade(())
    unlisted = universe.select("key").where("key IS NOT NULL")
    size = unlisted.count()
    chance = min(0.5, n / (math.sqrt(2) * size)) if size else 0.5
    levels = [_level(listed, n, chance, 0)]
    inside = listed
    # Only keys that pass are compared with the list.
    outside = materialize(
        unlisted.where(levels[0].passes(F.col("key"))).join(listed, "key", "left_anti").distinct()
    )
    while n := outside.count():
        level = _level(outside, n, 0.5, len(levels))
        levels.append(level)
        # The level holds one side; what it wrongly lets through is next.
        inside, outside = outside, materialize(inside.where(level.passes(F.col("key"))))
    return Cascade(tuple(levels))


def _level(keys: DataFrame, n: int, chance: float, seed: int) -> Level:
    bits = 32 * max(1, math.ceil(n * -math.log2(chance) / math.log(2) / 32))
    if bits > MOST_BITS:
        raise ValueError(f"{n} keys need a filter of {bits} bits, more than {MOST_BITS}")
    hashes = max(1, round(-math.log2(chance)))
    places = F.array(*_places(F.col("key"), bits, hashes, seed))
    words = (
        keys.select(F.explode(places).alias("place"))
        .select(F.shiftright("place", 5).alias("word"), F.expr("shiftleft(1L, cast(place & 31 as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
    )
    table = [0] * (bits // 32)
    for word, held in words.collect():
        table[word] = held
    return Level(bits, hashes, seed, tuple(table))


def _places(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(1000 * seed + i)), F.lit(bits)) for i in range(hashes)]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; both empty if it is null or has no ``://``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule] = RULES, id_column: str = "page_id", url_column: str = "url"
) -> DataFrame:
    """Rows (id, host, path, rule, verdict), one for each of ``pages``.

    Of the rules that fit, the longest (host and path) wins, and the first in
    order among equally long ones. ``rule`` is its host and path, null if none
    fits; then the key is on neither list and the verdict is ``allow``. A null
    url, or one without ``://``, has an empty host and path. Repeated rows are
    judged alike; other columns are ignored.
    """
    host, path = url_parts(F.col(url_column))
    parts = pages.select(F.col(id_column), host.alias("host"), path.alias("path"))
    # A url can ask for as many keys as the rules have shapes.
    shapes = sorted({(r.host.count(".") + 1, len(r.path)) for r in rules})
    keys = [
        F.concat(F.substring_index("host", ".", -labels), F.substring("path", 1, length))
        for labels, length in shapes
    ]
    keyed = parts.withColumn("keys", F.array(*keys) if keys else F.array().cast("array<string>"))
    spark = pages.sparkSession
    universe = materialize(keyed.select(F.explode("keys").alias("key")).distinct())
    lists = {}
    for verdict in ("block", "allow"):
        own = F.array(*[F.lit(r.key) for r in rules if r.verdict == verdict]).cast("array<string>")
        lists[verdict] = build_cascade(spark.range(1).select(F.explode(own).alias("key")), universe)

    def listed(key: Column) -> Column:
        return lists["block"].holds(key) | lists["allow"].holds(key)

    ranked = F.sort_array(
        F.transform(F.filter("keys", listed), lambda k: F.struct((-F.length(k)).alias("short"), k.alias("key")))
    )
    won = keyed.withColumn("rule", F.get(ranked, F.lit(0))["key"])
    verdict = F.when(F.col("rule").isNotNull() & lists["block"].holds(F.col("rule")), "block").otherwise("allow")
    return won.select(id_column, "host", "path", "rule", verdict.alias("verdict"))
