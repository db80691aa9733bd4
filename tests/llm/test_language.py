"""Nearest centroids against a plain computation, and accuracy on the contract's held-out documents."""

import zlib
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import language
from plumbline.llm.queries import op3_language

SCHEMA = "doc_id bigint, text string, lang string, source string, place int, vector int"
SETTINGS = language.Settings(buckets=512, centroids=3, sample=40)


def grams(text):
    """Counts of letter n-grams of one to three characters, a gap for whatever stands between words."""
    points = [" "]
    for c in f" {text or ''} ":
        c = (c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " "
        if c != " " or points[-1] != " ":
            points.append(c)
    points = points if points[-1] == " " else [*points, " "]
    found = Counter(c for c in points if c != " ")
    for n in (2, 3) if found else ():
        found.update("".join(points[i : i + n]) for i in range(len(points) - n + 1))
    return found


def bucket(gram, settings):
    number = 0
    for c in gram:
        number = (number << 21 | (0 if c == " " else ord(c))) & (1 << 64) - 1
    spread = (number + len(gram)) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    return ((spread ^ spread >> 29) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1) >> 40


def vector(text, model):
    counts = np.zeros(model.settings.buckets)
    for gram, n in grams(text).items():
        counts[bucket(gram, model.settings) % model.settings.buckets] += n
    weighed = np.log1p(counts) * model.idf
    return weighed / (np.linalg.norm(weighed) or 1.0)


@pytest.fixture(scope="module")
def rows():
    words = {"aa": "the and of with that", "bb": "der und die nicht ein", "cc": "le et les des une"}
    out = []
    for i in range(150):
        lang = ["aa", "bb", "cc"][i % 3]
        held = words[lang].split()
        out.append((i, " ".join(held[(i * k + k) % 5] for k in range(1, 9)) + f" {i}", lang, "s", 1, 2))
    return out + [(900, None, "aa", "s", 1, 2), (901, "12 !", "bb", "s", 1, 2), (902, "", None, "s", 1, 2), (903, "der die " * 5_000, None, "s", 1, 2), (904, "ß É", None, "s", 1, 2)]


def test_frequencies_vectors_and_cosines(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model = language.fit(docs, SETTINGS)
    known = [r for r in rows if r[1] is not None and r[2] is not None]
    held = np.zeros(SETTINGS.buckets)
    for _, text, *_ in known:
        held[list({bucket(g, SETTINGS) % SETTINGS.buckets for g in grams(text)})] += 1
    assert np.allclose(model.idf, np.log((len(known) + 1) / (held + 1)) + 1)
    assert set(model.languages) == {"aa", "bb", "cc"} and max(Counter(model.languages).values()) <= 3
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-5)
    # Each centroid is the direction of the mean of the sampled texts next to it.
    found = {r.doc_id: r for r in language.identify(docs, model).collect()}
    for doc_id, text, *_ in rows:
        r = found[doc_id]
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        cosines = model.centroids @ vector(text, model)
        assert r.score == pytest.approx(cosines.max(), abs=1e-5)
        assert cosines[model.languages.index(r.lang_pred) :][: model.languages.count(r.lang_pred)].max() == pytest.approx(cosines.max(), abs=2e-6)
    assert all(found[i].lang_pred == lang for i, text, lang, *_ in known if any(c.isalpha() for c in text))


def test_more_languages_than_any_limit_of_old(spark):
    """Every language counts, however many there are."""
    rows = [(i, chr(0x4E00 + i) * 3, f"l{i:04}", "s", 1, 2) for i in range(300)]
    model = language.fit(spark.createDataFrame(rows, SCHEMA), language.Settings(buckets=256, centroids=1, sample=2))
    assert sorted(set(model.languages)) == sorted(r[2] for r in rows)


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], SCHEMA)
    model = language.fit(empty, SETTINGS)
    docs = spark.createDataFrame([(1, "some text", None, "s", 1, 2), (None, None, None, None, None, None)], SCHEMA)
    assert {tuple(r) for r in language.identify(docs, model).collect()} == {(1, "und", 0.0, True), (None, "und", 0.0, True)}
    assert language.identify(empty, model).count() == 0


def test_held_out_documents(spark, folder):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = op3_language(spark, folder).collect()
    assert {r.doc_id: r.held_out for r in found} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in docs}
    held = [r for r in found if r.held_out and docs[r.doc_id] is not None and r.lang_pred != "und"]
    assert sum(r.lang_pred == docs[r.doc_id] for r in held) >= 0.97 * len(held) > 0
