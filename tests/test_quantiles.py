import math

import numpy as np
import pytest

from plumbline import quantiles

SHARES = [0.0, 0.01, 0.25, 1 / 3, 0.5, 0.9, 0.999, 1.0]


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(5)
    n = 3000
    ties = np.where(rng.random(n) < 0.34, 7.0, rng.normal(size=n))
    wide = rng.normal(size=n) * 10.0 ** rng.integers(-300, 300, n)
    return {
        "normal": rng.normal(size=n),
        "sorted": np.arange(n, dtype=float),
        "ties": ties,
        "few": rng.integers(0, 3, n).astype(float),
        "same": np.full(n, 2.5),
        "wide": wide,
        "lognormal": np.exp(5 * rng.normal(size=n)),
    }


def expected(values, share):
    return float(np.quantile(values, share))


@pytest.mark.parametrize("rows_per_task", [20, 400, 10**6])
def test_against_numpy(spark, numbers, rows_per_task):
    names = list(numbers)
    rows = [tuple(map(float, row)) for row in zip(*numbers.values())]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(5)
    got = quantiles(df, names, SHARES, rows_per_task=rows_per_task).collect()
    assert len(got) == len(names) * len(SHARES)
    for row in got:
        want = expected(numbers[row["column"]], row["share"])
        assert row["value"] == pytest.approx(want, rel=1e-9), row


def test_infinite_and_missing_values(spark):
    values = [math.inf, -math.inf, math.nan, None, 1.0, 2.0, 3.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = {r["share"]: r["value"] for r in quantiles(df, ["x"], [0.0, 0.5, 1.0]).collect()}
    assert got == {0.0: -math.inf, 0.5: 2.0, 1.0: math.inf}


def test_narrowing_keeps_infinite_ends(spark):
    values = [math.inf] * 400 + [-math.inf] * 400 + [float(i) for i in range(800)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    shares = [0.1, 0.25, 0.5, 0.7, 0.9]
    got = {r["share"]: r["value"] for r in quantiles(df, ["x"], shares, rows_per_task=10).collect()}
    in_order = sorted(values)
    for share in shares:
        place = share * (len(values) - 1)
        low, high = in_order[math.floor(place)], in_order[math.ceil(place)]
        part = place - math.floor(place)
        want = low if low == high or not part else (1 - part) * low + part * high
        assert got[share] == pytest.approx(want)


def test_no_values_give_no_row(spark):
    df = spark.createDataFrame([(None, 1), (None, 2)], "x double, y int")
    assert [r["column"] for r in quantiles(df, shares=[0.5]).collect()] == ["y"]
    assert quantiles(df, ["x"]).count() == 0


def test_text_is_refused(spark):
    with pytest.raises(TypeError):
        quantiles(spark.createDataFrame([("a",)], "s string"), ["s"])


def test_ranges_reach_the_scan(spark, folder):
    df = spark.read.parquet(f"{folder}/lineitem.parquet")
    found = quantiles(df, ["l_extendedprice"], [0.5], rows_per_task=500)
    plan = found._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(l_extendedprice" in plan
    assert "ReadSchema: struct<l_extendedprice:double>" in plan
