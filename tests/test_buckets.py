import math

import numpy as np
from pyspark.sql import functions as F

from plumbline.functions.buckets import OrderedBuckets


def placed(spark, values, **sizes):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    buckets = OrderedBuckets.fit(df, ["x"], **sizes)
    return buckets, sorted((r["value"], r["bucket"]) for r in buckets.long_form(df).collect())


def test_buckets_follow_the_values(spark):
    rng = np.random.default_rng(3)
    values = [
        *rng.normal(size=500),
        *(rng.normal(size=200) * 1e300),
        *(rng.normal(size=200) * 1e-310),
        *[0.0, -0.0, math.inf, -math.inf, 1.7e308, -1.7e308],
        *[4.0] * 400,
    ]
    for sizes in ({}, {"coarse": 300}, {"coarse": 2, "fine": 3}, {"coarse": 1, "fine": 1}):
        buckets, got = placed(spark, values, **sizes)
        assert len(got) == len(values)
        numbers = [b for _, b in got]
        assert numbers == sorted(numbers)
        assert {b for v, b in got if v == 4.0} == {dict(got)[4.0]}
        assert len(set(numbers)) <= len(buckets.cuts["x"]) * buckets.fine


def test_one_value_and_missing_values(spark):
    df = spark.createDataFrame([(2.0,), (None,), (math.nan,), (2.0,)], "x double")
    got = OrderedBuckets.fit(df, ["x"]).long_form(df).collect()
    assert [r["value"] for r in got] == [2.0, 2.0]
    empty = df.where("x IS NULL")
    assert OrderedBuckets.fit(empty, ["x"]).long_form(empty).count() == 0


def test_even_buckets(spark):
    df = spark.range(100_000).select(F.exp(F.randn(1) * 3).alias("x"))
    buckets = OrderedBuckets.fit(df, ["x"], coarse=1024)
    sizes = buckets.long_form(df).groupBy("bucket").count()
    # A long tail, where the even division does not help: still no bucket
    # holds more than a coarse range does.
    assert sizes.agg(F.max("count")).first()[0] <= 100_000 / 500
