"""The checks on the given tables, by name: ``(spark, folder) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plumbline import operators as op
from plumbline.functions.columns import col
from plumbline.plans.catalog import COLUMNS, EDGES, KEYS, RULES, UNUSED
from plumbline.sources.tables import read_table

Check = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, for comparing results of different summation orders."""
    return df.select(
        *[
            F.round(col(f.name), digits).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else col(f.name)
            for f in df.schema.fields
        ]
    )


def _tables(spark: SparkSession, folder: str, edges) -> dict[str, DataFrame]:
    names = sorted({e.child for e in edges} | {e.parent for e in edges})
    return {name: read_table(spark, folder, name) for name in names}


def _profile(table: str, spark: SparkSession, folder: str) -> DataFrame:
    return rounded(op.profile(read_table(spark, folder, table)))


def _quantiles_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = read_table(spark, folder, "lineitem")
    deciles = [i / 10 for i in range(11)]
    columns = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount"]
    return rounded(op.quantiles(lineitem, columns, deciles))


def _quantiles_events(spark: SparkSession, folder: str) -> DataFrame:
    events = read_table(spark, folder, "events")
    return rounded(op.quantiles(events, ["value"], [0.01, 0.25, 0.5, 0.75, 0.99]))


def _key_summary(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        op.key_summary(read_table(spark, folder, table), keys).select(
            F.lit(table).alias("table"), F.lit(",".join(keys)).alias("key"), "*"
        )
        for table, keys in KEYS.items()
    ]
    return op.report(parts)


def _key_duplicates(table: str, keys: list[str], spark: SparkSession, folder: str) -> DataFrame:
    return op.key_duplicates(read_table(spark, folder, table), keys)


def _references(edges, spark: SparkSession, folder: str) -> DataFrame:
    return op.reference_summary(_tables(spark, folder, edges), edges)


def _orphan_keys(edge: op.Edge, spark: SparkSession, folder: str) -> DataFrame:
    tables = _tables(spark, folder, [edge])
    return op.orphan_keys(
        tables[edge.child], edge.child_keys, tables[edge.parent], edge.parent_keys
    )


def _rules(table: str, spark: SparkSession, folder: str) -> DataFrame:
    return op.rule_check(read_table(spark, folder, table), RULES[table])


def _category_shares(table: str, level: str, group: str, spark, folder: str) -> DataFrame:
    return rounded(op.category_shares(read_table(spark, folder, table), level, group), 9)


def _category_levels(
    table: str, level: str, group: str, first, second, spark, folder: str
) -> DataFrame:
    df = read_table(spark, folder, table)
    return rounded(op.category_levels(df, level, group, first, second), 9)


def _category_distance(
    table: str, level: str, group: str, first, second, spark, folder: str
) -> DataFrame:
    df = read_table(spark, folder, table)
    return rounded(op.category_distance(df, level, group, first, second), 6)


def _ks(table: str, columns: list[str], group: str, first, second, spark, folder) -> DataFrame:
    df = read_table(spark, folder, table)
    return rounded(op.ks_statistics(df, columns, group, first, second), 9)


def _ks_price_by_quantity(spark: SparkSession, folder: str) -> DataFrame:
    """Groups that differ clearly: the price of small and of large quantities."""
    lineitem = read_table(spark, folder, "lineitem").withColumn(
        "amount", F.when(F.col("l_quantity") <= 25, "small").otherwise("large")
    )
    columns = ["l_extendedprice", "l_quantity"]
    return rounded(op.ks_statistics(lineitem, columns, "amount", "small", "large"), 9)


def _moments(table: str, columns, by: list[str], spark, folder: str) -> DataFrame:
    return rounded(op.moments(read_table(spark, folder, table), columns, by))


def _correlations(table: str, columns, spark: SparkSession, folder: str) -> DataFrame:
    return rounded(op.correlations(read_table(spark, folder, table), columns), 6)


EVENT_ORDER = ("events", "user_id", "event_id", "ts")
ORDER_ORDER = ("orders", "o_custkey", "o_orderkey", "o_orderdate")


def _order_gaps(where, spark: SparkSession, folder: str) -> DataFrame:
    table, entity, order, time = where
    df = read_table(spark, folder, table)
    return op.order_gaps(df, entity, order, time)


def _order_summary(where, spark: SparkSession, folder: str) -> DataFrame:
    table, entity, order, time = where
    df = read_table(spark, folder, table)
    return op.order_summary(df, entity, order, time)


def _report(spark: SparkSession, folder: str) -> DataFrame:
    """One table with the findings of all eight kinds of check."""
    lineitem = read_table(spark, folder, "lineitem")
    orders = read_table(spark, folder, "orders")
    events = read_table(spark, folder, "events")
    group = ("l_linestatus", "F", "O")
    parts = [
        op.findings(
            op.profile(lineitem), "profile", F.concat(F.lit("lineitem."), F.col("column"))
        ),
        op.findings(
            _key_summary(spark, folder), "key", F.concat_ws(".", F.col("table"), F.col("key"))
        ),
        op.findings(_references(EDGES, spark, folder), "reference", F.col("edge")),
        op.findings(op.rule_check(orders, RULES["orders"]), "rule", F.col("rule")),
        op.findings(op.rule_check(lineitem, RULES["lineitem"]), "rule", F.col("rule")),
        op.findings(
            op.category_distance(lineitem, "l_returnflag", *group),
            "category",
            "lineitem.l_returnflag by l_linestatus",
        ),
        op.findings(
            op.ks_statistics(lineitem, ["l_quantity"], *group),
            "distribution",
            F.concat(F.lit("lineitem."), F.col("column"), F.lit(" by l_linestatus")),
        ),
        op.findings(
            op.moments(events, ["value"]), "moments", F.concat(F.lit("events."), F.col("column"))
        ),
        op.findings(
            op.correlations(lineitem, ["l_quantity", "l_extendedprice"]),
            "correlation",
            F.concat_ws("~", F.col("left"), F.col("right")),
        ),
        op.findings(op.order_summary(events, *EVENT_ORDER[1:]), "order", "events by user_id"),
    ]
    return rounded(op.report(parts))


def checks() -> dict[str, Check]:
    status = ("l_linestatus", "F", "O")
    return {
        **{f"profile_{table}": partial(_profile, table) for table in COLUMNS},
        "quantiles_lineitem": _quantiles_lineitem,
        "quantiles_events": _quantiles_events,
        "key_summary": _key_summary,
        "key_duplicates_lineitem": partial(
            _key_duplicates, "lineitem", ["l_orderkey", "l_linenumber"]
        ),
        "key_duplicates_events_user": partial(_key_duplicates, "events", ["user_id"]),
        "references": partial(_references, EDGES),
        "references_unused": partial(_references, UNUSED),
        "orphan_keys_documents": partial(_orphan_keys, UNUSED[3]),
        **{f"rules_{table}": partial(_rules, table) for table in RULES},
        "category_shares_lineitem": partial(
            _category_shares, "lineitem", "l_returnflag", "l_linestatus"
        ),
        "category_shares_documents": partial(_category_shares, "documents", "source", "lang"),
        "category_levels_lineitem": partial(
            _category_levels, "lineitem", "l_returnflag", *status
        ),
        "category_levels_parts": partial(_category_levels, "lineitem", "l_partkey", *status),
        "category_distance_lineitem": partial(
            _category_distance, "lineitem", "l_returnflag", *status
        ),
        "category_distance_parts": partial(_category_distance, "lineitem", "l_partkey", *status),
        "category_distance_orders": partial(
            _category_distance, "orders", "o_orderpriority", "o_orderstatus", "F", "P"
        ),
        "ks_lineitem": partial(
            _ks, "lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], *status
        ),
        "ks_lineitem_price_by_quantity": _ks_price_by_quantity,
        "ks_orders": partial(_ks, "orders", ["o_totalprice"], "o_orderstatus", "F", "P"),
        "ks_events": partial(_ks, "events", ["value"], "event_type", "view", "purchase"),
        "moments_lineitem": partial(
            _moments, "lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], []
        ),
        "moments_events": partial(_moments, "events", ["value"], []),
        "moments_events_by_type": partial(_moments, "events", ["value"], ["event_type"]),
        "correlations_lineitem": partial(
            _correlations,
            "lineitem",
            ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey"],
        ),
        "correlations_events": partial(
            _correlations, "events", ["value", "user_id", "event_id"]
        ),
        "order_gaps_events": partial(_order_gaps, EVENT_ORDER),
        "order_gaps_orders": partial(_order_gaps, ORDER_ORDER),
        "order_summary_events": partial(_order_summary, EVENT_ORDER),
        "order_summary_orders": partial(_order_summary, ORDER_ORDER),
        "report": _report,
    }
