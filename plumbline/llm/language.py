"""Language identification by nearest centroid.

A text is a vector of TF-IDF weights of its character n-grams, hashed into a
fixed number of buckets and normalised. Each language has several centroids,
clustered from its texts. A text belongs to the language of the centroid of
largest cosine; one that is too far from it is marked as rejected.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from plumbline.llm.common import few_rows, materialize, ship

if TYPE_CHECKING:
    import pandas as pd

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """``sample`` texts of each language at most are clustered into ``centroids``.

    Document frequencies are counted over all texts that may be learned from.
    A text is rejected if its cosine is below ``reject`` times the one that all
    but a hundredth of the centroid's own texts reach.
    """

    buckets: int = 4096
    longest: int = 3
    centroids: int = 4
    sample: int = 1500
    rounds: int = 12
    reject: float = 0.5


@dataclass(frozen=True)
class Model:
    settings: Settings
    idf: np.ndarray
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    limits: np.ndarray


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from the columns ``doc_id``, ``text`` and ``lang`` of ``docs``.

    Rows without a language or without a letter teach nothing; a table without
    others gives a model that names no language. Texts are read whole, however
    long; their vectors are what is grouped. The model has ``buckets`` numbers for
    each centroid and comes to the driver. Repeated rows count each time.
    """
    ship(docs.sparkSession)
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    texts, held = _document_frequencies(known.select("text"), settings)
    idf = np.log((texts + 1) / (held + 1)) + 1
    sample = _sample(known, settings).mapInArrow(_sampled(settings, idf), "lang string, place int, vector binary")
    clustered = sample.groupBy("lang").applyInPandas(
        _cluster(settings, idf), "lang string, place int, centroid array<float>, low double"
    )
    found = sorted(clustered.collect(), key=lambda r: (r["lang"], r["place"]))
    return Model(
        settings,
        idf,
        [r["lang"] for r in found],
        np.array([r["centroid"] for r in found], dtype=np.float32).reshape(-1, settings.buckets),
        np.array([r["low"] for r in found]) * settings.reject,
    )


def identify(
    docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Rows (id, lang_pred, score, rejected), one for each of ``docs``.

    Only the text is looked at, all of it. ``score`` is the cosine, from 0 to 1.
    A text that is null or has no letter is ``und`` with score 0, as is every
    text under a model that has learned nothing. Ties go to the first language
    in order. A rejected text still names its nearest language. Repeated rows
    get equal answers; other columns are ignored.
    """
    ship(docs.sparkSession)
    names = ["id", "lang_pred", "score", "rejected"]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            found: list[str] = []
            scores, rejected = [], []
            for vectors, letters in _vectors(batch.column("text").to_pylist(), model.settings, model.idf):
                if not model.languages:
                    letters = np.zeros(len(vectors), dtype=bool)
                    best, near = np.zeros(len(vectors), dtype=int), np.zeros(len(vectors))
                else:
                    cosines = np.round(vectors @ model.centroids.T, 6)
                    best = cosines.argmax(axis=1)
                    near = np.clip(cosines[np.arange(len(best)), best].astype(float), 0, 1)
                found += [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
                scores.append(np.where(letters, near, 0.0))
                limit = model.limits[best] if model.languages else np.ones(len(best))
                rejected.append(~letters | (near < limit))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(found, pa.string()),
                    pa.array(np.concatenate([[], *scores])),
                    pa.array(np.concatenate([np.zeros(0, bool), *rejected])),
                ],
                names=names,
            )

    texts = docs.select(
        F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text")
    )
    return texts.mapInArrow(
        predict, "id bigint, lang_pred string, score double, rejected boolean"
    ).withColumnRenamed("id", id_column)


def _document_frequencies(texts: DataFrame, settings: Settings) -> tuple[int, np.ndarray]:
    """The number of texts, and how many hold an n-gram of each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = np.zeros(settings.buckets, dtype=np.int64), 0
        for batch in few_rows(batches):
            for counts in _counts(batch.column("text").to_pylist(), settings):
                held += counts > 0
                seen += 1
        buckets = np.concatenate([np.flatnonzero(held), [-1]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(buckets.astype(np.int32)), pa.array(np.append(held[held > 0], seen))], names=["bucket", "n"]
        )

    held, total = np.zeros(settings.buckets, dtype=np.int64), 0
    counted = texts.mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    for bucket, n in counted.collect():
        if bucket < 0:
            total = n
        else:
            held[bucket] = n
    return total, held


def _sample(known: DataFrame, settings: Settings) -> DataFrame:
    """At most ``sample`` texts of each language, those of the smallest hash of their id."""
    sizes = materialize(known.groupBy("lang").agg(F.count("*").alias("n")))
    hashed = known.join(sizes, "lang").withColumn(
        "u", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    )
    near = hashed.where(F.col("u") * F.col("n") <= 1.2 * settings.sample + 50)
    order = Window.partitionBy("lang").orderBy("u", "doc_id")
    return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= settings.sample).select("lang", "text", "place")


def _sampled(settings: Settings, idf: np.ndarray):
    """The vectors of the sample's texts that have a letter, for mapInArrow: bounded, however long the texts."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            parts = list(_vectors(batch.column("text").to_pylist(), settings, idf))
            if parts:
                vectors, letters = (np.concatenate(x) for x in zip(*parts))
                taken = pa.array(np.flatnonzero(letters))
                held = pa.array([v.tobytes() for v in vectors[letters]], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("lang").take(taken), batch.column("place").take(taken), held], names=["lang", "place", "vector"]
                )

    return weigh


def _cluster(settings: Settings, idf: np.ndarray):
    """Spherical k-means of the vectors of a language's sample, for applyInPandas."""

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd

        rows = rows.sort_values("place")
        vectors = np.stack([np.frombuffer(v, dtype=np.float32) for v in rows["vector"]])
        # Start from the mean, then from whatever is farthest from all so far.
        centers = [_unit(vectors.mean(axis=0))]
        while len(centers) < min(settings.centroids, len(vectors)):
            near = (vectors @ np.array(centers).T).max(axis=1)
            centers.append(vectors[int(near.argmin())])
        centers = np.array(centers)
        for _ in range(settings.rounds):
            own = (vectors @ centers.T).argmax(axis=1)
            moved = np.array(
                [_unit(vectors[own == i].mean(axis=0)) if (own == i).any() else centers[i] for i in range(len(centers))]
            )
            if np.allclose(moved, centers, atol=1e-5):
                break
            centers = moved
        cosines = vectors @ centers.T
        own = cosines.argmax(axis=1)
        used = [i for i in range(len(centers)) if (own == i).any()]
        return pd.DataFrame(
            {
                "lang": rows["lang"].iloc[0],
                "place": used,
                "centroid": [centers[i].astype(float).tolist() for i in used],
                "low": [float(np.quantile(cosines[own == i, i], 0.01)) for i in used],
            }
        )

    return cluster


def _unit(vector: np.ndarray) -> np.ndarray:
    return vector / (np.linalg.norm(vector) or 1.0)


def _vectors(
    texts: Sequence[str | None], settings: Settings, idf: np.ndarray, at_once: int = 256
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Normalised vectors of the texts, some at a time, and whether each has a letter."""
    for start in range(0, len(texts), at_once):
        counts = np.stack(list(_counts(texts[start : start + at_once], settings)))
        letters = counts.any(axis=1)
        vectors = (np.log1p(counts) * idf).astype(np.float32)
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        yield vectors / np.where(norms > 0, norms, 1), letters


_folded: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For every code point its lower-case letter, or 0 if it is none."""
    if not _folded:
        table = np.zeros(sys.maxunicode + 1, dtype=np.uint32)
        for c in range(sys.maxunicode + 1):
            letter = chr(c)
            if letter.isalpha():
                low = letter.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _folded.append(table)
    return _folded[0]


def _counts(texts: Sequence[str | None], settings: Settings) -> Iterator[np.ndarray]:
    """Counts of n-grams by bucket for each text; all 0 if it has no letter."""
    table = _letters()
    for text in texts:
        total = np.zeros(settings.buckets, dtype=np.int64)
        points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        points = table[np.concatenate([[32], points, [32]])]
        # One gap between words, whatever stands there.
        points = points[np.concatenate([[True], (points[1:] != 0) | (points[:-1] != 0)])].astype(np.uint64)
        if points.any():
            grams = points
            total += _bucketed(grams[points != 0], 1, settings)
            for n in range(2, settings.longest + 1):
                grams = (grams[:-1] << np.uint64(21)) | points[n - 1 :]
                total += _bucketed(grams, n, settings)
        yield total


def _bucketed(grams: np.ndarray, n: int, settings: Settings) -> np.ndarray:
    spread = (grams + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
    return np.bincount(
        ((spread ^ (spread >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % settings.buckets,
        minlength=settings.buckets,
    )
