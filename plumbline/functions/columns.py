"""What kind of values a column holds, and which of them count as present."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


def is_number(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def is_time(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_text(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.StringType)


def kind_of(data_type: T.DataType) -> str:
    """``number``, ``time``, ``text``, ``flag`` or ``other`` (nested and binary)."""
    if is_number(data_type):
        return "number"
    if is_time(data_type):
        return "time"
    if is_text(data_type):
        return "text"
    if isinstance(data_type, T.BooleanType):
        return "flag"
    return "other"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A top-level column by its exact name, dots and all."""
    return F.col(quoted(name))


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL: both mean "missing" here."""
    data_type = df.schema[name].dataType
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return F.nanvl(col(name), F.lit(None).cast(data_type))
    return col(name)


def number_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """The given columns, checked to be numeric; all numeric ones if none given."""
    if columns is None:
        return [f.name for f in df.schema.fields if is_number(f.dataType)]
    for name in columns:
        if not is_number(df.schema[name].dataType):
            raise TypeError(f"column {name!r} is not numeric")
    return list(columns)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def none_of(df: DataFrame, schema: str) -> DataFrame:
    """A result without rows: what is asked about no column or rule."""
    return df.sparkSession.createDataFrame([], schema)


def batches(items: Sequence, size: int) -> list[Sequence]:
    """The items in order, at most ``size`` at a time.

    Aggregates over many columns are built in batches: Spark gives up
    generated code beyond ``spark.sql.codegen.maxFields`` running values.
    """
    return [items[i : i + size] for i in range(0, len(items), size)]
