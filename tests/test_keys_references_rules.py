import pytest
from pyspark.sql import functions as F

from plumbline import (
    Edge,
    key_duplicates,
    key_summary,
    orphan_keys,
    reference_check,
    reference_summary,
    rule_check,
)


def test_missing_keys_are_equal(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (1, None), (None, "a")], "k int, s string")
    assert [tuple(r) for r in key_duplicates(df, ["k", "s"]).collect()] == [(1, None, 2)]
    assert tuple(key_summary(df, ["k"]).first()) == (4, 2, 1, 2)


def test_no_rows(spark):
    df = spark.createDataFrame([], "k int")
    assert tuple(key_summary(df, ["k"]).first()) == (0, 0, 0, 0)
    assert tuple(reference_check(df, ["k"], df, ["k"]).first()) == (0, 0, 0, 0)


def test_hot_key_is_counted_before_the_shuffle(spark):
    df = spark.range(90_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    found = key_duplicates(df, ["k"])
    assert [tuple(r) for r in found.collect()] == [(-1, 30_000)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning(k") < plan.rindex("partial_count")


def test_dropped_parents_leave_orphans(tables):
    orders = tables("orders").where("o_orderkey % 10 <> 0")
    lineitem = tables("lineitem")
    lost = lineitem.where("l_orderkey % 10 = 0")
    got = reference_check(lineitem, ["l_orderkey"], orders, ["o_orderkey"]).first()
    assert got["child_rows"] == lineitem.count()
    assert got["orphan_rows"] == lost.count() > 0
    assert got["orphan_keys"] == lost.select("l_orderkey").distinct().count()
    keys = orphan_keys(lineitem, ["l_orderkey"], orders, ["o_orderkey"])
    assert keys.agg(F.sum("n")).first()[0] == lost.count()
    assert keys.where("l_orderkey % 10 <> 0").count() == 0


def test_composite_and_missing_references(spark):
    child = spark.createDataFrame(
        [(1, "a"), (1, "b"), (1, "b"), (None, "b"), (2, None), (3, "c")], "x int, y string"
    )
    parent = spark.createDataFrame(
        [(1, "a"), (1, "a"), (3, "c"), (3, "c"), (None, "b"), (2, None)], "p int, q string"
    )
    got = reference_check(child, ["x", "y"], parent, ["p", "q"]).first()
    assert tuple(got) == (6, 2, 1, 2)
    assert [tuple(r) for r in orphan_keys(child, ["x", "y"], parent, ["p", "q"]).collect()] == [
        (1, "b", 2)
    ]


def test_edges_are_named(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(1,)], "k int")
    edges = [Edge("a", ("k",), "b", ("k",)), Edge("b", ("k",), "a", ("k",))]
    got = {r["edge"]: r["orphan_rows"] for r in reference_summary({"a": a, "b": b}, edges).collect()}
    assert got == {"a(k)->b": 1, "b(k)->a": 0}
    with pytest.raises(ValueError):
        Edge("a", ("k",), "b", ("k", "l"))


def test_counting_children_serves_the_join(spark):
    """Each side is shuffled once: the join needs no exchange of its own."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = spark.range(1000).select((F.col("id") % 40).alias("k"))
        b = spark.range(30).select(F.col("id").alias("p"))
        got = reference_check(a, ["k"], b, ["p"])
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2
        assert tuple(got.first()) == (1000, 0, 10, 250)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_rules_that_are_neither_kept_nor_broken(spark):
    df = spark.createDataFrame([(1,), (None,), (-1,), (-2,)], "x int")
    got = rule_check(df, {"positive": "x > 0", "present": F.col("x").isNotNull()})
    assert {tuple(r) for r in got.collect()} == {("positive", 4, 2, 1), ("present", 4, 1, 0)}


def test_many_rules_on_few_rows(spark):
    df = spark.range(10)
    got = rule_check(df, {f"below {i}": f"id < {i}" for i in range(100)}).collect()
    assert {r["rule"]: r["violations"] for r in got} == {
        f"below {i}": max(10 - i, 0) for i in range(100)
    }
    assert rule_check(df.where("id < 0"), {"r": "id > 0"}).first()["rows"] == 0


def test_rules_read_only_their_columns(spark, folder):
    df = spark.read.parquet(f"{folder}/lineitem.parquet")
    plan = rule_check(df, {"r": "l_tax < l_discount"})._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_discount:double,l_tax:double>" in plan
