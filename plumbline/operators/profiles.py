"""Column profile: one row of facts per column."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.functions.columns import batches, is_text, kind_of, none_of, number_columns, present
from plumbline.operators.selection import quantiles

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
# Longer strings are told apart by their SHA-256 digest, which is longer than
# any string kept as it is.
LONGEST_PLAIN_TEXT = 64

PROFILE_SCHEMA = {
    "column": "string",
    "kind": "string",
    "rows": "bigint",
    "nulls": "bigint",
    "distinct": "bigint",
    "min_number": "double",
    "max_number": "double",
    "mean": "double",
    "sd": "double",
    "q1": "double",
    "median": "double",
    "q3": "double",
    "min_text": "string",
    "max_text": "string",
}


def profile(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Rows, missing values, distinct values, extremes, mean, sd and quartiles.

    Numeric columns fill the number fields; text, time and boolean columns fill
    ``min_text`` and ``max_text``, as do whole numbers and decimals, with all
    their digits. NaN counts as missing. ``sd`` is the sample
    standard deviation.

    With ``exact=False`` distinct counts and quartiles are estimates, and the
    whole profile is a single pass over the table without a shuffle of values.
    """
    columns = list(columns) if columns is not None else df.columns
    parts = [_single_pass(df, columns, exact)]
    if exact:
        parts.append(distinct_counts(df, columns))
        numbers = [c for c in columns if kind_of(df.schema[c].dataType) == "number"]
        if numbers:
            parts.append(_quartiles(df, numbers))
    # A handful of rows per column: combining them is one tiny aggregate.
    together = reduce(lambda a, b: a.unionByName(b), [_padded(p) for p in parts])
    return together.groupBy("column").agg(
        *[F.max(name).alias(name) for name in PROFILE_SCHEMA if name != "column"]
    )


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Exact number of distinct present values: rows (``column``, ``distinct``).

    One narrow branch per column. Several ``count_distinct`` in one aggregate
    would instead copy every row once per column, each copy as wide as all of
    them. Duplicates are removed before the shuffle, so a frequent value costs
    one row per task.
    """
    columns = list(columns) if columns is not None else df.columns
    if not columns:
        return none_of(df, "column string, distinct bigint")
    branches = [
        df.select(_comparable(df, name).alias("value"))
        .where(F.col("value").isNotNull())
        .distinct()
        .agg(F.count("*").alias("distinct"))
        .select(F.lit(name).alias("column"), "distinct")
        for name in columns
    ]
    return reduce(lambda a, b: a.unionByName(b), branches)


def _comparable(df: DataFrame, name: str) -> Column:
    data_type = df.schema[name].dataType
    value = present(df, name)
    if isinstance(data_type, T.MapType):
        # Equal maps have equal entries, in whatever order.
        value, data_type = F.array_sort(F.map_entries(value)), T.ArrayType(
            T.StructType().add("key", data_type.keyType).add("value", data_type.valueType)
        )
    if "map<" in data_type.simpleString():
        # Maps inside can't be grouped; their text has every digit of a time.
        micros = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
        formats = {"timestampFormat": micros, "timestampNTZFormat": micros}
        return F.when(value.isNotNull(), F.sha2(F.to_json(F.struct(value.alias("value")), formats), 256))
    if not is_text(data_type) and data_type.typeName() != "binary":
        return value
    digest = F.concat(F.lit("sha256:"), F.sha2(value, 256))
    return F.when(F.length(value) > LONGEST_PLAIN_TEXT, digest).otherwise(value)


def _single_pass(df: DataFrame, columns: Sequence[str], exact: bool) -> DataFrame:
    """The facts that need no shuffle of values.

    Numeric and other columns go into aggregates of their own, a few columns
    each: Spark gives up generated code for an aggregate that keeps too many
    running values, and text extremes slow down the numeric ones beside them.
    """
    numbers = [c for c in columns if kind_of(df.schema[c].dataType) == "number"]
    others = [c for c in columns if c not in numbers]
    branches = [
        _facts(df, part, exact) for part in [*batches(numbers, 8), *batches(others, 8)]
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), branches)


def _facts(df: DataFrame, columns: Sequence[str], exact: bool) -> DataFrame:
    facts: list[Column] = [F.count("*").alias("rows")]
    entries: list[Column] = []
    for i, name in enumerate(columns):
        kind = kind_of(df.schema[name].dataType)
        value = present(df, name)
        number = value.cast("double")
        found: dict[str, Column] = {}
        if kind == "number":
            found = {
                "min_number": F.min(value).cast("double"),
                "max_number": F.max(value).cast("double"),
                "mean": F.avg(number),
                "sd": F.stddev_samp(number),
            }
            # A double can't hold every digit of whole numbers and decimals.
            inexact = isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))
            exact_value = F.lit(None) if inexact else value
            found |= {
                "min_text": F.min(exact_value).cast("string"),
                "max_text": F.max(exact_value).cast("string"),
            }
        elif kind == "other":
            found = dict.fromkeys(("min_text", "max_text"), F.max(F.lit(None).cast("string")))
        else:
            found = {
                "min_text": F.min(value).cast("string"),
                "max_text": F.max(value).cast("string"),
            }
        if not exact:
            found["distinct"] = F.approx_count_distinct(_comparable(df, name))
        if not exact and kind == "number":
            shares = [F.lit(s) for s in QUARTILES.values()]
            found["quartiles"] = F.percentile_approx(number, F.array(*shares))
        facts.append(F.count(value).alias(f"count_{i}"))
        facts += [fact.alias(f"{field}_{i}") for field, fact in found.items()]
        fields = {field: F.col(f"{field}_{i}") for field in found}
        if "quartiles" in fields:
            quartiles = fields.pop("quartiles")
            fields |= {q: quartiles[j] for j, q in enumerate(QUARTILES)}
        entries.append(
            F.struct(
                F.lit(name).alias("column"),
                F.lit(kind).alias("kind"),
                F.col("rows"),
                (F.col("rows") - F.col(f"count_{i}")).alias("nulls"),
                *[value.alias(field) for field, value in fields.items()],
            )
        )
    return df.agg(*facts).select(F.inline(F.array(*entries)))


def _quartiles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    found = quantiles(df, number_columns(df, columns), list(QUARTILES.values()))
    return found.select(
        "column",
        *[
            F.when(F.col("share") == share, F.col("value")).alias(name)
            for name, share in QUARTILES.items()
        ],
    )


def _padded(part: DataFrame) -> DataFrame:
    return part.select(
        *[
            (F.col(name) if name in part.columns else F.lit(None).cast(data_type)).alias(name)
            for name, data_type in PROFILE_SCHEMA.items()
        ]
    )
