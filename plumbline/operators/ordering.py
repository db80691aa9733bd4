"""Order check in time: gaps and backward steps between neighbouring rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F, types as T

from plumbline.functions.columns import col, present
from plumbline.functions.times import interval_micros


def order_gaps(
    df: DataFrame, entity: str, order: str, time: str, parts: int | None = None
) -> DataFrame:
    """Per entity: how ``time`` moves when its rows are read in ``order``.

    Rows (entity, ``rows``, ``gaps``, ``backward_steps``, ``shortest_gap_us``,
    ``longest_gap_us``); a backward step is a negative gap. ``order`` is of any
    type that can be sorted, ``time`` a timestamp or a date; equal ``order``
    values are read by ``time``. Rows where one of the three is missing (NULL or
    NaN) have no place and are left out.

    The rows are sorted by entity, order and time and cut into ``parts`` ranges
    of like size (by default as many as shuffle partitions), wherever an entity
    begins or ends. Gaps are taken inside each range, and the first and last
    time of an entity's part give the gaps across the cuts, so no task has to
    hold one entity.
    """
    return _gaps(df, entity, order, time, parts).withColumnRenamed("entity", entity)


def _gaps(df: DataFrame, entity: str, order: str, time: str, parts: int | None) -> DataFrame:
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    when = col(time)
    if isinstance(df.schema[time].dataType, T.DateType):
        when = when.cast("timestamp_ntz")
    rows = df.select(
        present(df, entity).alias("entity"), present(df, order).alias("order"), when.alias("time")
    ).where("entity IS NOT NULL AND order IS NOT NULL AND time IS NOT NULL")
    ranged = rows.repartitionByRange(parts, "entity", "order", "time")
    # The number of a range follows the order of its rows.
    chunked = ranged.withColumn("chunk", F.spark_partition_id())

    chunks = _with_gap(chunked, Window.partitionBy("entity", "chunk").orderBy("order", "time"))
    position = F.struct("order", "time")
    chunks = chunks.groupBy("entity", "chunk").agg(
        F.count("*").alias("rows"),
        F.count("gap").alias("gaps"),
        F.count_if(_backward()).alias("backward_steps"),
        F.min("gap").alias("shortest"),
        F.max("gap").alias("longest"),
        F.min_by("time", position).alias("first"),
        F.max_by("time", position).alias("last"),
    )
    # At most one row per entity and range.
    in_entity = Window.partitionBy("entity").orderBy("chunk")
    bordered = chunks.withColumn("gap", F.col("first") - F.lag("last").over(in_entity))
    return (
        bordered.groupBy("entity")
        .agg(
            F.sum("rows").alias("rows"),
            (F.sum("gaps") + F.count("gap")).alias("gaps"),
            (F.sum("backward_steps") + F.count_if(_backward())).alias("backward_steps"),
            F.min(F.least("shortest", "gap")).alias("shortest"),
            F.max(F.greatest("longest", "gap")).alias("longest"),
        )
        .select(
            "entity",
            "rows",
            "gaps",
            "backward_steps",
            interval_micros(F.col("shortest")).alias("shortest_gap_us"),
            interval_micros(F.col("longest")).alias("longest_gap_us"),
        )
    )


def order_summary(
    df: DataFrame, entity: str, order: str, time: str, parts: int | None = None
) -> DataFrame:
    """``order_gaps`` over all entities, in one row."""
    zero = F.lit(0).cast("bigint")
    return _gaps(df, entity, order, time, parts).agg(
        F.count("*").alias("entities"),
        F.coalesce(F.sum("rows"), zero).alias("rows"),
        F.coalesce(F.sum("gaps"), zero).alias("gaps"),
        F.coalesce(F.sum("backward_steps"), zero).alias("backward_steps"),
        F.min("shortest_gap_us").alias("shortest_gap_us"),
        F.max("longest_gap_us").alias("longest_gap_us"),
    )


def _with_gap(rows: DataFrame, neighbours: WindowSpec) -> DataFrame:
    return rows.withColumn("gap", F.col("time") - F.lag("time").over(neighbours))


def _backward() -> Column:
    return F.col("gap") < F.expr("INTERVAL '0' SECOND")
