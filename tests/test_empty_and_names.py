"""Checks of no column or rule, and of columns named like a result's."""

import datetime as dt

from plumbline import (
    correlations,
    distinct_counts,
    key_duplicates,
    key_summary,
    moments,
    order_gaps,
    order_summary,
    rule_check,
)


def test_nothing_to_check(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "g string, x int")
    texts = df.select("g")
    for found, like in [
        (moments(texts), moments(df)),
        (moments(texts, by=["g"]), moments(df, by=["g"])),
        (correlations(df), correlations(df.selectExpr("x", "x + 1 AS y"))),
        (rule_check(df, {}), rule_check(df, {"r": "x > 0"})),
        (distinct_counts(df, []), distinct_counts(df)),
    ]:
        assert found.collect() == []
        assert found.dtypes == like.dtypes


def test_keys_named_like_the_count(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "n int, n_ int")
    assert [tuple(r) for r in key_duplicates(df, ["n"]).collect()] == [(1, 2)]
    assert [tuple(r) for r in key_duplicates(df, ["n", "n_"]).collect()] == [(1, 1, 2)]
    assert tuple(key_summary(df, ["n"]).first()) == (3, 2, 1, 1)


def test_entities_named_like_a_fact(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(e, i, start + dt.timedelta(hours=i)) for e in "ab" for i in range(3)]
    for name in ("rows", "gaps", "entity", "shortest"):
        df = spark.createDataFrame(rows, f"`{name}` string, `order` int, `time` timestamp_ntz")
        found = order_gaps(df, name, "order", "time", 2)
        assert found.columns[0] == name and sorted(r[:3] for r in map(tuple, found.collect())) == [("a", 3, 2), ("b", 3, 2)]
        assert tuple(order_summary(df, name, "order", "time", 2).first())[:4] == (2, 6, 4, 0)
