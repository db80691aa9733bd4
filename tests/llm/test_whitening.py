"""Contour integration and whitening against a dense eigensolver and exact sums."""

from fractions import Fraction
from math import floor

import numpy as np
import pytest

from plumbline.llm import whitening
from plumbline.llm.feast import Contour, count_below, largest_eigenpairs
from plumbline.llm.queries import op12_whitening

SCHEMA = "vec_id bigint, embedding array<double>, n int, deviation string, x int"


def symmetric(values, seed=0):
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0]
    return (turn * values) @ turn.T, turn


@pytest.mark.parametrize("seed", range(8))
def test_inertia(seed):
    random = np.random.default_rng(seed)
    a = random.normal(size=(25, 25))
    a = a + a.T
    if seed % 2:
        a[np.arange(25), np.arange(25)] = 0  # no pivot of size one to begin with
    values = np.linalg.eigvalsh(a)
    for cut in random.uniform(values[0] - 1, values[-1] + 1, 40):
        assert count_below(a, cut) == (values < cut).sum()


SPECTRA = {
    "falling": 1.3 ** -np.arange(40.0),
    "flat": 1 + 1e-3 * np.arange(40.0),
    "equal": np.array([3.0] * 20 + [1.0] * 20),
    "close": np.concatenate([2 + 1e-9 * np.arange(18), np.linspace(0, 1, 22)]),
    "few": np.array([5.0, 4.0, 4.0, 0, 0, 0, 0, 0]),
    "wide": 10.0 ** np.arange(-4, 6),
    "one": np.array([2.5]),
    "none": np.zeros(5),
    "tie at the end": np.array([9.0] * 3 + [5.0] * 30),
}


@pytest.mark.parametrize("name", SPECTRA)
@pytest.mark.parametrize("wanted", [1, 16])
def test_eigenpairs(name, wanted):
    values = np.sort(SPECTRA[name])[::-1]
    matrix, _ = symmetric(values)
    found, vectors = largest_eigenpairs(matrix, wanted)
    above = values[values > 1e-12 * values[0]] if values[0] else values[:0]
    assert len(found) == min(wanted, len(above))
    assert np.allclose(found, above[:wanted], rtol=1e-12, atol=1e-13 * values[0])
    assert np.allclose(vectors.T @ vectors, np.eye(len(found)), atol=1e-13)
    assert np.abs(matrix @ vectors - vectors * found).max(initial=0) <= 1e-13 * max(values[0], 1e-300)


def test_more_eigenvalues_than_the_first_space_holds():
    matrix, _ = symmetric(np.r_[1 + 1e-13 * np.arange(30), np.zeros(10)])
    found, _ = largest_eigenpairs(matrix, 16, Contour(crowd=2))
    assert np.allclose(found, 1, atol=1e-12)


def exact(vectors):
    """n, sums and the covariance of distinct quantised vectors."""
    rows = [tuple(floor(64 * float(c)) + whitening.SHIFT for c in v) for v in vectors]
    fit = sorted(set(rows))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(Fraction(c) - Fraction(s, n)) for c, s in zip(row, sums)] for row in fit])
    return rows, n, sums, centred.T @ centred / n


def check(found, ids, vectors, k):
    rows, n, sums, covariance = exact(vectors)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    by_id = {}
    for r in found:
        by_id.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    signs = {}
    for i, row in zip(ids, rows):
        assert sorted(by_id[i]) == list(range(1, k + 1))
        centred = np.array([float(Fraction(c) - Fraction(s, n)) for c, s in zip(row, sums)])
        for component, answers in by_id[i].items():
            truth = centred @ axes[:, component - 1] / np.sqrt(values[component - 1])
            for r in answers:
                assert (r.n, r.deviation) == (n, sum((n * c - s) ** 2 for c, s in zip(row, sums)))
                assert r.explained == pytest.approx(values[component - 1] / np.trace(covariance), rel=1e-9)
                assert r.identity_error < 1e-9
                if abs(truth) > 1e-6:
                    signs.setdefault(component, set()).add(np.sign(r.whitened * truth))
                assert abs(abs(r.whitened) - abs(truth)) < 1e-8
    assert all(len(s) == 1 for s in signs.values())


def test_given_vectors(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    found = op12_whitening(spark, folder).collect()
    assert len(found) == 16 * len(table)
    check(found, [r.vec_id for r in table], [r.embedding for r in table], 16)


def of(spark, rows, tmp_path):
    spark.createDataFrame([(i, v, 1, "d", 2) for i, v in rows], SCHEMA).repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    return op12_whitening(spark, str(tmp_path)).collect()


def test_awkward_vectors(spark, tmp_path):
    """Copies count once; nulls, other lengths and non-finite entries take no part; fewer components than 16."""
    random = np.random.default_rng(2)
    good = [(i, [float(c) for c in random.normal(size=5) * [9, 5, 3, 2, 1]]) for i in range(60)]
    good += [(100 + i, [0.5, 1.0, -2.0, 0.25, 0.0]) for i in range(200)] + [(None, [0.0] * 5), (7, good[7][1]), (300, [1e-12] * 5)]
    bad = [(400, None), (401, [1.0, None, 1.0, 1.0, 1.0]), (402, [float("nan")] * 5), (403, [float("inf")] * 5), (404, []), (405, [1.0] * 4)]
    found = of(spark, good + bad, tmp_path)
    assert len(found) == 5 * len(good)
    check(found, [i for i, _ in good], [v for _, v in good], 5)


def test_no_directions(spark, tmp_path):
    assert of(spark, [], tmp_path / "none") == []
    assert of(spark, [(1, None)], tmp_path / "null") == []
    assert of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.001])], tmp_path / "same") == []
    line = of(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], tmp_path / "line")
    assert len(line) == 9 and all(r.explained == pytest.approx(1.0) for r in line)


def test_huge_entries(spark, tmp_path):
    """Beyond 64 bits the deviation is null; the rest stays finite."""
    rows = [(i, [1e15 * i, float(i % 3)]) for i in range(10)] + [(50, [1e300, 1.0])]
    found = of(spark, rows, tmp_path)
    assert {r.vec_id for r in found} == {i for i, _ in rows}
    assert all(r.deviation is None and np.isfinite(r.whitened) for r in found)
