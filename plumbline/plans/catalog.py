"""What is expected of the tables under test: keys, references and rules."""

from __future__ import annotations

from plumbline.operators.references import Edge

# Columns per table and their kind: n number, t text, d time, a nested.
COLUMNS = {
    "customer": "c_custkey:n c_name:t c_nationkey:n c_acctbal:n c_mktsegment:t",
    "supplier": "s_suppkey:n s_name:t s_nationkey:n s_acctbal:n",
    "part": "p_partkey:n p_name:t p_brand:t p_type:t p_size:n p_retailprice:n",
    "orders": (
        "o_orderkey:n o_custkey:n o_orderstatus:t o_totalprice:n o_orderdate:d "
        "o_orderpriority:t"
    ),
    "lineitem": (
        "l_orderkey:n l_partkey:n l_suppkey:n l_linenumber:n l_quantity:n "
        "l_extendedprice:n l_discount:n l_tax:n l_returnflag:t l_linestatus:t l_shipdate:d"
    ),
    "events": "event_id:n ts:d user_id:n event_type:t value:n props:t",
    "documents": "doc_id:n text:t lang:t source:t n_chars:n",
    "embeddings": "vec_id:n embedding:a label:n",
    "pages": "page_id:n url:t html:t",
    "benchmark": "item_id:n text:t",
    "labels": "doc_id:n quality:n toxic:n",
    "conversations": "conv_id:n turn:n role:t text:t",
}

KEYS = {
    "customer": ("c_custkey",),
    "supplier": ("s_suppkey",),
    "part": ("p_partkey",),
    "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_linenumber"),
    "events": ("event_id",),
    "documents": ("doc_id",),
    "embeddings": ("vec_id",),
    "pages": ("page_id",),
    "benchmark": ("item_id",),
    "labels": ("doc_id",),
    "conversations": ("conv_id", "turn"),
}

EDGES = (
    Edge("lineitem", ("l_orderkey",), "orders", ("o_orderkey",)),
    Edge("lineitem", ("l_partkey",), "part", ("p_partkey",)),
    Edge("lineitem", ("l_suppkey",), "supplier", ("s_suppkey",)),
    Edge("orders", ("o_custkey",), "customer", ("c_custkey",)),
    Edge("customer", ("c_nationkey",), "nation", ("n_nationkey",)),
    Edge("supplier", ("s_nationkey",), "nation", ("n_nationkey",)),
    Edge("nation", ("n_regionkey",), "region", ("r_regionkey",)),
    Edge("labels", ("doc_id",), "documents", ("doc_id",)),
)

# The other way round: rows that nothing refers to.
UNUSED = (
    Edge("orders", ("o_orderkey",), "lineitem", ("l_orderkey",)),
    Edge("part", ("p_partkey",), "lineitem", ("l_partkey",)),
    Edge("customer", ("c_custkey",), "orders", ("o_custkey",)),
    Edge("documents", ("doc_id",), "labels", ("doc_id",)),
)

RULES = {
    "orders": {
        "price is positive": "o_totalprice > 0",
        "price is below 400000": "o_totalprice < 400000",
        "status is known": "o_orderstatus IN ('F', 'O', 'P')",
        "order is finished": "o_orderstatus = 'F'",
        "placed from 1996 on": "o_orderdate >= TIMESTAMP '1996-01-01 00:00:00'",
    },
    "lineitem": {
        "quantity is 1 to 50": "l_quantity BETWEEN 1 AND 50",
        "discount is at most 5 percent": "l_discount <= 0.05",
        "tax is below discount": "l_tax < l_discount",
        "unit price is at least 1000": "l_extendedprice >= 1000 * l_quantity",
        "returned only if finished": "l_returnflag <> 'R' OR l_linestatus = 'F'",
    },
    "events": {
        "value is positive": "value > 0",
        "value is at most 400": "value <= 400",
        "purchase is at least 1": "event_type <> 'purchase' OR value >= 1",
        "in January 2024": (
            "ts >= TIMESTAMP '2024-01-01 00:00:00' AND ts < TIMESTAMP '2024-01-31 00:00:00'"
        ),
    },
}


def columns_of(table: str) -> dict[str, str]:
    return dict(entry.split(":") for entry in COLUMNS[table].split())
