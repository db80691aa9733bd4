import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from plumbline import order_gaps, order_summary

START = dt.datetime(2024, 1, 1)
SCHEMA = "who string, at long, ts timestamp_ntz"


def by_hand(rows):
    """The gaps of each entity from its sorted rows."""
    found = {}
    for who in {r[0] for r in rows}:
        times = [r[2] for r in sorted((r for r in rows if r[0] == who), key=lambda r: r[1:])]
        gaps = [
            (b - a) // dt.timedelta(microseconds=1) for a, b in zip(times, times[1:])
        ]
        found[who] = (
            len(times),
            len(gaps),
            sum(g < 0 for g in gaps),
            min(gaps, default=None),
            max(gaps, default=None),
        )
    return found


def collected(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    """One entity holds a third of the rows, and some steps go back."""
    rng = random.Random(8)
    made = []
    for i in range(3000):
        who = "hot" if i % 3 == 0 else f"u{rng.randrange(200)}"
        time = START + dt.timedelta(seconds=i * 60 + rng.randrange(-200, 200), microseconds=i)
        made.append((who, i // 2 * 7, time))
    return made + [("alone", 5, START)]


@pytest.mark.parametrize("parts", [None, 1, 7, 60])
def test_against_sorted_rows(spark, rows, parts):
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = order_gaps(df, "who", "at", "ts", parts)
    assert got.columns[0] == "who"
    assert collected(got) == by_hand(rows)


def test_large_entities_are_spread(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    plan = order_gaps(df, "who", "at", "ts", 9)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(entity" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("parts", [1, 5])
@pytest.mark.parametrize("kind", ["double", "string", "date", "timestamp", "timestamp_ntz"])
def test_order_of_any_type(spark, kind, parts):
    made = spark.range(200).select(
        F.lit("a").alias("who"),
        F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, cast(id % 90 as int))").alias("day"),
        F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, cast(id as int))").alias("ts"),
        "id",
    )
    at = {"double": F.expr("if(id % 10 = 0, double('NaN'), id / 3)"), "string": F.format_string("%05d", "id")}
    df = made.withColumn("at", at.get(kind, F.col("day").cast(kind) if kind not in at else None))
    rows = 180 if kind == "double" else 200
    got = collected(order_gaps(df, "who", "at", "ts", parts))["a"]
    assert got[:2] == (rows, rows - 1)
    assert got == collected(order_gaps(df, "who", "at", "ts", 40))["a"]


def test_dates_as_time(spark):
    df = spark.sql("SELECT 'a' AS who, id AS at, date_add(date'2024-01-01', cast(id as int)) AS ts FROM range(5)")
    day = 86_400_000_000
    assert collected(order_gaps(df, "who", "at", "ts")) == {"a": (5, 4, 0, day, day)}


def test_rows_without_a_place_are_left_out(spark):
    rows = [
        ("a", 1, START),
        ("a", 2, None),
        ("a", None, START),
        (None, 3, START),
        ("a", 4, START + dt.timedelta(hours=1)),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    hour = 3_600_000_000
    assert collected(order_gaps(df, "who", "at", "ts")) == {"a": (2, 1, 0, hour, hour)}


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert order_gaps(df, "who", "at", "ts").count() == 0
    assert tuple(order_summary(df, "who", "at", "ts").first()) == (0, 0, 0, 0, None, None)


def test_the_session_zone_does_not_matter(spark):
    """Zone-less times around a daylight-saving switch only move forward."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        times = [dt.datetime(2024, 3, 31, 2, 30), dt.datetime(2024, 3, 31, 3, 10)]
        df = spark.createDataFrame([("a", i, t) for i, t in enumerate(times)], SCHEMA)
        gap = 40 * 60 * 1_000_000
        assert collected(order_gaps(df, "who", "at", "ts")) == {"a": (2, 1, 0, gap, gap)}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_shifted_events_step_back(tables):
    events = tables("events")
    assert order_summary(events, "user_id", "event_id", "ts").first()["backward_steps"] == 0
    shifted = events.withColumn(
        "ts",
        F.when(F.col("event_id") % 10 == 0, F.col("ts") - F.expr("INTERVAL '40' DAY")).otherwise(
            F.col("ts")
        ),
    )
    whole, cut = (
        order_summary(shifted, "user_id", "event_id", "ts", n).first() for n in (10**6, 5)
    )
    assert whole == cut
    assert whole["backward_steps"] > 0
