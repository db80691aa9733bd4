"""Quality rules: how a text's words compare with trusted and with raw text.

Words and word pairs are hashed into a fixed number of buckets. Two multinomials
are counted over them, one from trusted documents and one from all of them, and
a text's score is the mean log-likelihood ratio of its n-grams. Simple counts
of symbols and repeats (the base rules) come with it.

Everything is DataFrame functions on a row's own arrays; the only shuffle is of
bucket counts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.common import GAP_CHARACTERS, WORD, let, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Weights:
    """Log-likelihood ratio of each bucket."""

    values: list[float]

    def column(self) -> Column:
        # One constant of the plan; an array of so many literals is rewritten by every rule.
        return F.split(F.lit(",".join(map(repr, self.values))), ",").cast("array<double>")


def trusted_ids(labels: DataFrame, most: int = 20_000) -> DataFrame:
    """Ids of documents labelled good and not toxic, ``most`` of them at most.

    The labelled rows are a sample anyway; which of them are taken is set by a
    hash of the id. The bound makes their ids small enough to be broadcast
    (160 KB), so that no text is shuffled to find the trusted ones.
    """
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL")
    return good.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit_weights(
    docs: DataFrame,
    trusted: DataFrame,
    buckets: int = 10_000,
    smoothing: float = 1.0,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> Weights:
    """Count the n-grams of all documents and of the trusted ones by bucket.

    ``trusted`` holds ids, few enough to broadcast (see ``trusted_ids``).
    ``buckets`` numbers come to the driver, whatever the size of the corpus.
    Without trusted documents all weights are 0.
    """
    marks = trusted.select(F.col("doc_id").alias("trusted_id")).distinct()
    texts = docs.select(F.col(id_column).alias("id"), words_of(F.col(text_column)).alias("words"))
    marked = texts.join(F.broadcast(marks), F.col("id") == F.col("trusted_id"), "left")
    hashes = marked.select(F.col("trusted_id").isNotNull().alias("good"), _word_hashes(F.col("words")).alias("h"))
    grams = hashes.select("good", F.explode(F.concat("h", _joined(F.col("h"), 1))).alias("gram"))
    counted = grams.groupBy(F.pmod("gram", F.lit(buckets)).alias("bucket")).agg(
        F.count("*").alias("raw"), F.count_if("good").alias("good")
    )
    raw, good = [0] * buckets, [0] * buckets
    for row in counted.collect():
        raw[row["bucket"]], good[row["bucket"]] = row["raw"], row["good"]
    if not sum(good):
        return Weights([0.0] * buckets)
    # Both are smoothed towards the raw distribution.
    all_raw, all_good = sum(raw) + smoothing * buckets, sum(good)
    share = [(r + smoothing) / all_raw for r in raw]
    prior = smoothing * buckets
    return Weights(
        [
            round(math.log((g + prior * s) / (all_good + prior) / s), 6)
            for g, s in zip(good, share)
        ]
    )


def score_quality(
    docs: DataFrame,
    weights: Weights,
    threshold: float = -0.08,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """The rows with ``n_words``, the base counts, ``llr``, ``base_failed`` and ``kept``.

    Rows (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, llr, kept), one for each of ``docs``; a null text counts as
    empty. ``llr`` is the mean over the text's words and word pairs, 0 without
    any. ``kept`` needs the base rules and ``llr >= threshold``; the same text
    gets the same verdict wherever it stands. Repeated rows are judged alike,
    and other columns are ignored.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    size = F.size("h").cast("bigint")
    counted = (
        docs.select(F.col(id_column).alias("id"), text.alias("t"), words_of(text).alias("w"))
        .select("id", "t", _word_hashes(F.col("w")).alias("h"))
        .select("id", "t", "h", _joined(F.col("h"), 1).alias("pairs"))
        .select(
            "id",
            size.alias("n_words"),
            (F.char_length("t") - _occurrences(F.col("t"), GAP_CHARACTERS)).cast("bigint").alias("word_chars"),
            _occurrences(F.col("t"), SYMBOLS).cast("bigint").alias("n_symbols"),
            _duplicate_lines(F.col("t")).cast("bigint").alias("n_dup_lines"),
            _repeated_words(F.col("pairs")).cast("bigint").alias("n_repeat_words"),
            _mean_weight(F.col("h"), F.col("pairs"), weights).alias("llr"),
        )
    )
    failed = F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")
    return counted.select(
        F.col("id").alias(id_column),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        "llr",
        (~failed & (F.col("llr") >= threshold)).alias("kept"),
    )


def keep_good(
    docs: DataFrame, weights: Weights, threshold: float = -0.08, text_column: str = "text"
) -> DataFrame:
    """The rows that ``score_quality`` keeps, with all their columns; the test is a filter."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    verdict = let(
        _word_hashes(words_of(text)),
        lambda h: let(
            _joined(h, 1),
            lambda pairs: (F.size(h) >= 20)
            & (100 * _repeated_words(pairs) <= 30 * F.size(h))
            & (_mean_weight(h, pairs, weights) >= threshold),
        ),
    )
    return docs.where(verdict)


def _word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _joined(hashes: Column, step: int) -> Column:
    """Each hash with the one ``step`` places on, as far as there is one."""
    ahead = F.slice(hashes, F.lit(step + 1), F.size(hashes))
    return F.slice(
        F.zip_with(hashes, ahead, lambda a, b: F.xxhash64(a, b)),
        F.lit(1),
        F.greatest(F.size(hashes) - step, F.lit(0)),
    )


def _occurrences(text: Column, characters: str) -> Column:
    """How many characters of the text are among these ASCII characters."""
    rest = text
    for c in characters:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return F.octet_length(text) - F.octet_length(rest)


def _duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    return let(lines, lambda found: F.size(found) - F.size(F.array_distinct(found)))


def _repeated_words(pairs: Column) -> Column:
    """Words in windows of eight that the text holds twice or more."""

    def covered(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = let(
            placed,
            lambda p: F.array_sort(
                F.array_distinct(
                    F.flatten(
                        F.zip_with(
                            p,
                            F.slice(p, F.lit(2), F.size(p)),
                            lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(
                                F.array().cast("array<int>")
                            ),
                        )
                    )
                )
            ),
        )
        steps = let(
            starts,
            lambda s: F.zip_with(
                s,
                F.slice(s, F.lit(2), F.size(s)),
                lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))),
            ),
        )
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    fours = let(pairs, lambda p: _joined(p, 2))
    windows = let(fours, lambda f: _joined(f, 4))
    return let(
        windows,
        lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0)),
    )


def _mean_weight(hashes: Column, pairs: Column, weights: Weights) -> Column:
    table, buckets = weights.column(), F.lit(len(weights.values))

    def total(grams: Column) -> Column:
        return F.aggregate(
            grams,
            F.lit(0.0),
            lambda acc, gram: acc + F.get(table, F.pmod(gram, buckets).cast("int")),
        )

    n = F.size(hashes) + F.size(pairs)
    return F.when(n > 0, F.round((total(hashes) + total(pairs)) / n, 6)).otherwise(F.lit(0.0))
