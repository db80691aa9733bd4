from collections import Counter

import numpy as np
import pytest
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.stat import ChiSquareTest
from pyspark.sql import functions as F

from plumbline import (
    category_distance,
    category_levels,
    category_shares,
    correlations,
    ks_statistics,
    moments,
)


def pairs(first, second):
    return [(v, "a") for v in first] + [(v, "b") for v in second]


def distance(first, second):
    """Total variation and chi-square by definition."""
    a, b = Counter(first), Counter(second)
    n_a, n_b = len(first), len(second)
    variation = chi_square = 0.0
    for level in set(a) | set(b):
        variation += abs(a[level] / n_a - b[level] / n_b) / 2
        for seen, n in ((a[level], n_a), (b[level], n_b)):
            expected = (a[level] + b[level]) * n / (n_a + n_b)
            chi_square += (seen - expected) ** 2 / expected
    return variation, chi_square, len(set(a) | set(b)) - 1


def test_distance_by_definition(spark):
    first, second = list("xxxyyz") * 7, list("xyyyw") * 11
    df = spark.createDataFrame(pairs(first, second), "v string, g string")
    got = category_distance(df, "v", "g", "a", "b").first()
    variation, chi_square, degrees = distance(first, second)
    assert (got["levels"], got["n_first"], got["n_second"]) == (4, 42, 55)
    assert got["total_variation"] == pytest.approx(variation)
    assert got["chi_square"] == pytest.approx(chi_square)
    assert got["degrees"] == degrees

    levels = {r["level"]: r.asDict() for r in category_levels(df, "v", "g", "a", "b").collect()}
    assert levels["w"]["n_first"] == 0 and levels["w"]["share_second"] == pytest.approx(0.2)
    assert levels["x"]["difference"] == pytest.approx(0.5 - 0.2)


def test_chi_square_agrees_with_spark_ml(tables):
    lineitem = tables("lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    # Shift the flags so that the two groups differ.
    shifted = lineitem.withColumn(
        "flag",
        F.when((F.col("l_linestatus") == "F") & (F.col("l_quantity") < 20), "A").otherwise(
            F.col("l_returnflag")
        ),
    )
    indexer = StringIndexer(inputCols=["flag", "l_linestatus"], outputCols=["x", "y"])
    indexed = indexer.fit(shifted).transform(shifted)
    vectors = VectorAssembler(inputCols=["x"], outputCol="features").transform(indexed)
    want = ChiSquareTest.test(vectors, "features", "y", flatten=True).first()
    got = category_distance(shifted, "flag", "l_linestatus", "F", "O").first()
    assert got["chi_square"] == pytest.approx(want["statistic"])
    assert got["degrees"] == want["degreesOfFreedom"]
    assert got["chi_square"] > 100


def test_a_group_without_rows(spark):
    df = spark.createDataFrame([("x", "a")], "v string, g string")
    got = category_distance(df, "v", "g", "a", "b").first()
    assert (got["levels"], got["n_first"], got["n_second"]) == (1, 1, 0)
    assert got["total_variation"] is got["chi_square"] is got["degrees"] is None
    none = category_distance(df, "v", "g", "c", "d").first()
    assert (none["levels"], none["n_first"], none["total_variation"]) == (0, 0, None)


def test_shares_leave_out_missing_levels(spark):
    rows = [("x", "a"), ("x", "a"), ("y", "a"), (None, "a"), ("x", None), ("x", "b")]
    df = spark.createDataFrame(rows, "v string, g string")
    got = {(r["level"], r["group"]): r["share"] for r in category_shares(df, "v", "g").collect()}
    assert got == {("x", "a"): 2 / 3, ("y", "a"): 1 / 3, ("x", "b"): 1.0}


def ks(first, second):
    """The statistic by definition."""
    values = np.unique(np.concatenate([first, second]))
    a = np.searchsorted(np.sort(first), values, side="right") / len(first)
    b = np.searchsorted(np.sort(second), values, side="right") / len(second)
    return float(np.max(np.abs(a - b)))


RNG = np.random.default_rng(11)
SAMPLES = {
    "same": (RNG.normal(size=900), RNG.normal(size=700)),
    "shifted": (RNG.normal(size=900), RNG.normal(size=700) + 1),
    "apart": (RNG.random(500), RNG.random(300) + 5),
    "ties": (RNG.integers(0, 4, 800).astype(float), RNG.integers(0, 5, 800).astype(float)),
    "wider": (RNG.normal(size=600), RNG.normal(size=900) * 4),
    "one value": (np.full(50, 3.0), np.full(70, 3.0)),
    "hot value": (
        np.where(RNG.random(900) < 0.34, 0.5, RNG.random(900)),
        np.where(RNG.random(900) < 0.30, 0.5, RNG.random(900)),
    ),
    "heavy tail": (np.exp(9 * RNG.normal(size=700)), np.exp(8 * RNG.normal(size=800))),
    "single": (np.array([1.0]), np.array([1.0, 2.0])),
}


@pytest.mark.parametrize("name", SAMPLES)
def test_ks_by_definition(spark, name):
    first, second = (list(map(float, s)) for s in SAMPLES[name])
    df = spark.createDataFrame(pairs(first, second), "v double, g string")
    got = ks_statistics(df, ["v"], "g", "a", "b").first()
    assert (got["n_first"], got["n_second"]) == (len(first), len(second))
    assert got["statistic"] == pytest.approx(ks(first, second), abs=1e-12)


def test_ks_on_a_shifted_copy(tables):
    lineitem = tables("lineitem").select("l_extendedprice", "l_linestatus")
    shifted = lineitem.withColumn(
        "l_extendedprice",
        F.col("l_extendedprice") + F.when(F.col("l_linestatus") == "F", 9000).otherwise(0),
    )
    sides = [
        [r[0] for r in shifted.where(F.col("l_linestatus") == s).select("l_extendedprice").collect()]
        for s in "FO"
    ]
    got = ks_statistics(shifted, ["l_extendedprice"], "l_linestatus", "F", "O").first()
    assert got["statistic"] == pytest.approx(ks(*map(np.array, sides)), abs=1e-12)
    assert got["statistic"] > 0.05


def test_ks_without_values(spark):
    rows = [(1.0, None, "a"), (2.0, float("nan"), "b"), (5.0, 1.0, "c")]
    df = spark.createDataFrame(rows, "x double, y double, g string")
    got = {r["column"]: r.asDict() for r in ks_statistics(df, ["x", "y"], "g", "a", "b").collect()}
    assert got["x"]["statistic"] == 1.0
    assert got["y"] == {"column": "y", "n_first": 0, "n_second": 0, "statistic": None}
    one_side = ks_statistics(df, ["x"], "g", "a", "z").first()
    assert (one_side["n_first"], one_side["n_second"], one_side["statistic"]) == (1, 0, None)


def test_ks_of_many_values(spark):
    """Far more values than a bucket holds, with most buckets left closed."""
    df = spark.range(200_000).select(
        F.rand(3).alias("u"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g")
    ).select(F.when(F.col("g") == "a", F.col("u")).otherwise(F.col("u") ** 3).alias("v"), "g")
    got = ks_statistics(df.repartition(4), ["v"], "g", "a", "b")
    first, second = (
        np.array([r[0] for r in df.where(F.col("g") == s).select("v").collect()]) for s in "ab"
    )
    assert got.first()["statistic"] == pytest.approx(ks(first, second), abs=1e-12)


def test_moments_by_definition(spark):
    values = [1.0, 2.0, 2.0, 9.0, 40.0]
    rows = [("g", v, 5.0) for v in values] + [("h", 3.0, 5.0), ("h", None, 5.0)]
    df = spark.createDataFrame(rows, "g string, x double, c double")
    got = {(r["g"], r["column"]): r.asDict() for r in moments(df, by=["g"]).collect()}
    d = np.array(values) - np.mean(values)
    row = got[("g", "x")]
    assert row["n"] == 5
    assert row["sd"] == pytest.approx(np.std(values, ddof=1))
    assert row["skewness"] == pytest.approx(np.mean(d**3) / np.mean(d**2) ** 1.5)
    assert row["kurtosis"] == pytest.approx(np.mean(d**4) / np.mean(d**2) ** 2 - 3)
    assert got[("g", "c")]["skewness"] is None and got[("g", "c")]["sd"] == 0
    assert (got[("h", "x")]["n"], got[("h", "x")]["sd"]) == (1, None)


def test_correlation_of_present_pairs(spark):
    rows = [(1.0, 2.0, 1), (2.0, 4.1, 1), (3.0, 5.9, 1), (None, 1.0, 1), (9.0, float("nan"), 1)]
    df = spark.createDataFrame(rows, "x double, y double, c int")
    got = {(r["left"], r["right"]): r.asDict() for r in correlations(df).collect()}
    assert got[("x", "y")]["n"] == 3
    assert got[("x", "y")]["correlation"] == pytest.approx(
        np.corrcoef([1, 2, 3], [2, 4.1, 5.9])[0, 1]
    )
    assert got[("x", "c")]["correlation"] is None


def test_many_columns(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(50, 9))
    names = [f"c{i}" for i in range(9)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], ", ".join(f"{n} double" for n in names))
    got = {(r["left"], r["right"]): r["correlation"] for r in correlations(df).collect()}
    want = np.corrcoef(data.T)
    assert len(got) == 36
    for (left, right), value in got.items():
        assert value == pytest.approx(want[names.index(left), names.index(right)])
    assert moments(df).count() == 9


def test_correlations_of_many_columns_in_one_pass(spark, tmp_path):
    """Every pair of 40 columns with gaps, as if it were alone; the table is read once."""
    random = np.random.default_rng(8)
    table = random.normal(size=(200, 40)) @ random.normal(size=(40, 40))
    table[random.random(table.shape) < 0.2] = np.nan
    table[:, 7] = 3.0
    names = [f"c{i}" for i in range(40)]
    rows = [[None if np.isnan(v) else float(v) for v in row] for row in table]
    spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).write.parquet(f"{tmp_path}/t")
    df = correlations(spark.read.parquet(f"{tmp_path}/t"))
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    found = {(r.left, r.right): r for r in df.collect()}
    assert len(found) == 40 * 39 // 2
    for (left, right), r in found.items():
        x, y = table[:, names.index(left)], table[:, names.index(right)]
        both = ~np.isnan(x) & ~np.isnan(y)
        assert r.n == both.sum()
        if 7 in (names.index(left), names.index(right)):
            assert r.correlation is None
        else:
            assert r.correlation == pytest.approx(np.corrcoef(x[both], y[both])[0, 1])
    empty = correlations(spark.createDataFrame([], "a int, b int, c int"))
    assert sorted(map(tuple, empty.collect())) == [("a", "b", 0, None), ("a", "c", 0, None), ("b", "c", 0, None)]
