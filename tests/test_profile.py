import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plumbline import distinct_counts, profile


def by_column(df):
    return {row["column"]: row.asDict() for row in df.collect()}


def test_missing_values_and_kinds(spark):
    rows = [
        (1, 1.5, "b", True, dt.date(2024, 1, 2), Decimal("1.10"), [1, 2]),
        (1, float("nan"), "a", None, dt.date(2023, 1, 2), Decimal("1.10"), [1, 2]),
        (None, 0.0, None, False, None, None, [2, 1]),
        (4, -0.0, "", False, None, Decimal("3.30"), None),
    ]
    schema = "i int, x double, s string, b boolean, d date, m decimal(10,2), a array<int>"
    got = by_column(profile(spark.createDataFrame(rows, schema)))

    assert [got[c]["nulls"] for c in "ixsbdma"] == [1, 1, 1, 1, 2, 1, 1]
    assert [got[c]["distinct"] for c in "ixsbdma"] == [2, 2, 3, 2, 2, 2, 2]
    assert {r["rows"] for r in got.values()} == {4}
    assert (got["i"]["min_number"], got["i"]["max_number"], got["i"]["mean"]) == (1, 4, 2)
    assert got["x"]["median"] == 0 and got["x"]["q3"] == 0.75
    assert (got["s"]["min_text"], got["s"]["max_text"]) == ("", "b")
    assert (got["b"]["min_text"], got["b"]["max_text"]) == ("false", "true")
    assert (got["d"]["min_text"], got["d"]["max_text"]) == ("2023-01-02", "2024-01-02")
    assert got["m"]["q1"] == pytest.approx(1.1)
    assert got["a"]["kind"] == "other" and got["a"]["min_text"] is None


def test_no_rows_and_no_values(spark):
    got = by_column(profile(spark.createDataFrame([], "x double, s string")))
    assert got["x"]["rows"] == got["x"]["distinct"] == 0
    assert got["x"]["mean"] is None and got["x"]["median"] is None
    got = by_column(profile(spark.createDataFrame([(None, "a")], "x double, s string")))
    assert (got["x"]["nulls"], got["x"]["distinct"], got["x"]["q1"]) == (1, 0, None)


def test_column_names_with_dots(spark):
    df = spark.createDataFrame([(1.0, "x"), (2.0, "y")], "`a.b` double, `c d` string")
    got = by_column(profile(df))
    assert got["a.b"]["median"] == 1.5 and got["c d"]["distinct"] == 2


def test_long_text_is_told_apart(spark):
    long = "x" * 100_000
    df = spark.createDataFrame([(long,), (long + "y",), (long,), ("x" * 64,)], "s string")
    assert distinct_counts(df).first()["distinct"] == 3
    # A short text that looks like the digest of a long one is still its own.
    digest = df.where(F.length("s") == 100_000).select(F.sha2("s", 256)).first()[0]
    alike = spark.createDataFrame([(digest,), ("0" * 64,)], "s string")
    assert distinct_counts(df.unionByName(alike)).first()["distinct"] == 5


def test_a_value_in_a_third_of_the_rows(spark):
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("x")
    )
    got = by_column(profile(df))["x"]
    assert got["distinct"] == 20_000  # 7 is among the other values as well


def test_more_columns_than_one_batch(spark):
    df = spark.range(10).select(*[(F.col("id") * i).alias(f"c{i}") for i in range(20)])
    got = by_column(profile(df))
    assert [got[f"c{i}"]["mean"] for i in range(20)] == [4.5 * i for i in range(20)]


def test_estimates_are_close(tables):
    lineitem = tables("lineitem")
    exact, estimate = (by_column(profile(lineitem, exact=e)) for e in (True, False))
    for name, row in exact.items():
        assert estimate[name]["distinct"] == pytest.approx(row["distinct"], rel=0.15)
        assert estimate[name]["mean"] == row["mean"]
        if row["kind"] == "number":
            # An estimate is a value of the column whose rank is close.
            median = estimate[name]["median"]
            below, upto = lineitem.agg(
                F.avg((F.col(name) < median).cast("int")), F.avg((F.col(name) <= median).cast("int"))
            ).first()
            assert below <= 0.51 and upto >= 0.49


def test_estimates_do_not_shuffle_values(tables):
    plan = profile(tables("lineitem"), exact=False)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_" not in plan


@pytest.mark.parametrize("shape", ["array(t)", "struct(t)", "map('a', t)", "array(struct(map('a', t)))"])
def test_nested_times_are_told_apart(spark, shape):
    df = spark.range(1000).selectExpr("timestamp_micros(id) AS t").selectExpr(f"{shape} AS x")
    assert by_column(profile(df.union(df)))["x"]["distinct"] == 1000


def test_extremes_of_large_numbers(spark):
    df = spark.sql("SELECT id + 9007199254740993 AS x, cast(id + 0.12 as decimal(30, 2)) AS y, id * 0.5D AS z FROM range(3)")
    got = by_column(profile(df))
    assert (got["x"]["min_text"], got["x"]["max_text"]) == ("9007199254740993", "9007199254740995")
    assert (got["y"]["min_text"], got["z"]["min_text"]) == ("0.12", None)
