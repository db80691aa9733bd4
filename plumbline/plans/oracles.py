"""The same checks as plain SQL, to compare results with another engine."""

from __future__ import annotations

from plumbline.plans.catalog import COLUMNS, EDGES, KEYS, RULES, UNUSED, columns_of

KINDS = {"n": "number", "t": "text", "d": "time", "a": "other"}


def _union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _profile_column(table: str, name: str, kind: str, digits: int = 4) -> str:
    number = kind == "n"
    text = kind in "td"

    def num(expr: str) -> str:
        value = f"round(CAST({expr} AS DOUBLE), {digits})" if number else "CAST(NULL AS DOUBLE)"
        return value

    def txt(expr: str) -> str:
        if number:  # all but floating-point numbers
            return f"CASE WHEN any_value(typeof({name})) NOT IN ('DOUBLE', 'FLOAT') THEN CAST({expr} AS VARCHAR) END"
        return f"CAST({expr} AS VARCHAR)" if text else "CAST(NULL AS VARCHAR)"

    return f"""SELECT {_text(name)} AS "column", '{KINDS[kind]}' AS kind,
  count(*) AS "rows", count(*) - count({name}) AS nulls,
  count(DISTINCT {name}) AS "distinct",
  {num(f"min({name})")} AS min_number, {num(f"max({name})")} AS max_number,
  {num(f"avg({name})")} AS mean, {num(f"stddev_samp({name})")} AS sd,
  {num(f"quantile_cont(CAST({name} AS DOUBLE), 0.25)")} AS q1,
  {num(f"quantile_cont(CAST({name} AS DOUBLE), 0.5)")} AS median,
  {num(f"quantile_cont(CAST({name} AS DOUBLE), 0.75)")} AS q3,
  {txt(f"min({name})")} AS min_text, {txt(f"max({name})")} AS max_text
FROM {table}"""


def _profile(table: str) -> str:
    # A nested column has neither extremes nor quantiles to cast.
    parts = []
    for name, kind in columns_of(table).items():
        parts.append(_profile_column(table, name, kind))
    return _union(parts)


def _quantiles(table: str, columns, shares) -> str:
    return _union(
        f'SELECT {_text(c)} AS "column", CAST({s!r} AS DOUBLE) AS share, '
        f"round(quantile_cont(CAST({c} AS DOUBLE), {s!r}), 4) AS value FROM {table}"
        for c in columns
        for s in shares
    )


def _key_summary(table: str, keys) -> str:
    joined = ", ".join(keys)
    return f"""SELECT '{table}' AS "table", '{",".join(keys)}' AS "key",
  CAST(sum(n) AS BIGINT) AS "rows", count(*) AS keys,
  count(*) FILTER (n > 1) AS repeated_keys,
  CAST(sum(n) - count(*) AS BIGINT) AS surplus_rows
FROM (SELECT {joined}, count(*) AS n FROM {table} GROUP BY {joined})"""


def _key_duplicates(table: str, keys) -> str:
    joined = ", ".join(keys)
    return f"SELECT {joined}, count(*) AS n FROM {table} GROUP BY {joined} HAVING count(*) > 1"


def _reference(edge) -> str:
    child, parent = edge.child_keys[0], edge.parent_keys[0]
    orphan = f"c.{child} IS NOT NULL AND p.{parent} IS NULL"
    return f"""SELECT '{edge.name}' AS edge, count(*) AS child_rows,
  count(*) FILTER (c.{child} IS NULL) AS unset_rows,
  count(DISTINCT c.{child}) FILTER ({orphan}) AS orphan_keys,
  count(*) FILTER ({orphan}) AS orphan_rows
FROM {edge.child} c LEFT JOIN (SELECT DISTINCT {parent} FROM {edge.parent}) p
  ON c.{child} = p.{parent}"""


def _orphan_keys(edge) -> str:
    child, parent = edge.child_keys[0], edge.parent_keys[0]
    return f"""SELECT {child}, count(*) AS n FROM {edge.child} c
WHERE {child} IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM {edge.parent} p WHERE p.{parent} = c.{child})
GROUP BY {child}"""


def _rules(table: str) -> str:
    return _union(
        f"""SELECT {_text(name)} AS rule, count(*) AS "rows",
  count(*) FILTER (NOT ({rule})) AS violations,
  count(*) FILTER (({rule}) IS NULL) AS unknown
FROM {table}"""
        for name, rule in RULES[table].items()
    )


def _category_shares(table: str, level: str, group: str) -> str:
    return f"""SELECT {level} AS "level", {group} AS "group", count(*) AS n,
  round(count(*) / sum(count(*)) OVER (PARTITION BY {group}), 9) AS share
FROM {table} WHERE {level} IS NOT NULL AND {group} IS NOT NULL GROUP BY {level}, {group}"""


def _side_by_side(table: str, level: str, group: str, first: str, second: str) -> str:
    return f"""SELECT {level} AS "level",
    count(*) FILTER ({group} = '{first}') AS n_first,
    count(*) FILTER ({group} = '{second}') AS n_second
  FROM {table}
  WHERE {level} IS NOT NULL AND {group} IN ('{first}', '{second}') GROUP BY {level}"""


def _category_levels(*of) -> str:
    return f"""WITH counts AS ({_side_by_side(*of)}),
shares AS (SELECT *, n_first / sum(n_first) OVER () AS a,
  n_second / sum(n_second) OVER () AS b FROM counts)
SELECT "level", n_first, n_second, round(a, 9) AS share_first, round(b, 9) AS share_second,
  round(a - b, 9) AS difference FROM shares"""


def _category_distance(*of, digits: int = 6) -> str:
    return f"""WITH counts AS ({_side_by_side(*of)}),
totals AS (SELECT *, CAST(sum(n_first) OVER () AS DOUBLE) AS a,
  CAST(sum(n_second) OVER () AS DOUBLE) AS b FROM counts),
expected AS (SELECT *, (n_first + n_second) * a / (a + b) AS e_first,
  (n_first + n_second) * b / (a + b) AS e_second FROM totals)
SELECT count(*) AS levels, CAST(sum(n_first) AS BIGINT) AS n_first,
  CAST(sum(n_second) AS BIGINT) AS n_second,
  round(sum(abs(n_first / a - n_second / b)) / 2, {digits}) AS total_variation,
  round(sum((n_first - e_first) ** 2 / e_first + (n_second - e_second) ** 2 / e_second),
    {digits}) AS chi_square,
  count(*) - 1 AS degrees
FROM expected"""


def _ks_column(table: str, name: str, group: str, first: str, second: str, digits: int) -> str:
    return f"""SELECT {_text(name)} AS "column", CAST(max(a) AS BIGINT) AS n_first,
  CAST(max(b) AS BIGINT) AS n_second,
  round(max(abs(a / total_a - b / total_b)), {digits}) AS statistic
FROM (SELECT sum(n_a) OVER upto AS a, sum(n_b) OVER upto AS b,
    sum(n_a) OVER () AS total_a, sum(n_b) OVER () AS total_b
  FROM (SELECT {name} AS value, count(*) FILTER ({group} = '{first}') AS n_a,
      count(*) FILTER ({group} = '{second}') AS n_b
    FROM {table} WHERE {name} IS NOT NULL AND {group} IN ('{first}', '{second}')
    GROUP BY {name})
  WINDOW upto AS (ORDER BY value RANGE UNBOUNDED PRECEDING))"""


def _ks(table: str, columns, group: str, first: str, second: str, digits: int = 9) -> str:
    return _union(_ks_column(table, c, group, first, second, digits) for c in columns)


AMOUNT = (
    "(SELECT *, CASE WHEN l_quantity <= 25 THEN 'small' ELSE 'large' END AS amount FROM lineitem)"
)


def _moments(table: str, columns, by=()) -> str:
    # Spelled out from the deviations: the built-in skewness and kurtosis of
    # other engines correct for small samples.
    keys = "".join(f"{b}, " for b in by)
    group = f" GROUP BY {', '.join(by)}" if by else ""
    over = f"PARTITION BY {', '.join(by)}" if by else ""
    return _union(
        f"""SELECT {keys}'{c}' AS "column", count(d) AS n, round(max(mean), 4) AS mean,
  round(sqrt(sum(d ** 2) / (count(d) - 1)), 4) AS sd,
  round(sqrt(count(d)) * sum(d ** 3) / sum(d ** 2) ** 1.5, 4) AS skewness,
  round(count(d) * sum(d ** 4) / sum(d ** 2) ** 2 - 3, 4) AS kurtosis
FROM (SELECT {keys}avg({c}) OVER ({over}) AS mean, {c} - avg({c}) OVER ({over}) AS d
  FROM {table}){group}"""
        for c in columns
    )


def _correlations(table: str, columns, digits: int = 6) -> str:
    return _union(
        f"""SELECT '{a}' AS "left", '{b}' AS "right",
  count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n,
  round(corr({a}, {b}), {digits}) AS correlation FROM {table}"""
        for i, a in enumerate(columns)
        for b in columns[i + 1 :]
    )


def _gaps(table: str, entity: str, order: str, time: str) -> str:
    return f"""SELECT {entity} AS entity, epoch_us({time})
    - lag(epoch_us({time})) OVER (PARTITION BY {entity} ORDER BY {order}, {time}) AS gap
  FROM {table}
  WHERE {entity} IS NOT NULL AND {order} IS NOT NULL AND {time} IS NOT NULL"""


def _order_gaps(table: str, entity: str, order: str, time: str) -> str:
    return f"""SELECT entity AS {entity}, count(*) AS "rows", count(gap) AS gaps,
  count(*) FILTER (gap < 0) AS backward_steps,
  min(gap) AS shortest_gap_us, max(gap) AS longest_gap_us
FROM ({_gaps(table, entity, order, time)}) GROUP BY entity"""


def _order_summary(table: str, entity: str, order: str, time: str) -> str:
    return f"""SELECT count(DISTINCT entity) AS entities, count(*) AS "rows", count(gap) AS gaps,
  count(*) FILTER (gap < 0) AS backward_steps,
  min(gap) AS shortest_gap_us, max(gap) AS longest_gap_us
FROM ({_gaps(table, entity, order, time)})"""


EVENT_ORDER = ("events", "user_id", "event_id", "ts")
ORDER_ORDER = ("orders", "o_custkey", "o_orderkey", "o_orderdate")
STATUS = ("l_linestatus", "F", "O")


def _findings(result: str, check: str, subject: str, metrics) -> str:
    names = ", ".join(f'"{m}"' for m in metrics)
    values = ", ".join(f'CAST("{m}" AS DOUBLE) AS "{m}"' for m in metrics)
    return f"""SELECT '{check}' AS "check", subject, metric, round(value, 4) AS value
FROM (UNPIVOT (SELECT {subject} AS subject, {values} FROM ({result}))
  ON {names} INTO NAME metric VALUE value)"""


def _report() -> str:
    facts = ["rows", "nulls", "distinct", "min_number", "max_number", "mean", "sd"]
    quartiles = ["q1", "median", "q3"]
    rules = ["rows", "violations", "unknown"]
    return _union(
        [
            _findings(
                _profile("lineitem"), "profile", "'lineitem.' || \"column\"", facts + quartiles
            ),
            _findings(
                _union(_key_summary(t, k) for t, k in KEYS.items()),
                "key",
                '"table" || \'.\' || "key"',
                ["rows", "keys", "repeated_keys", "surplus_rows"],
            ),
            _findings(
                _union(_reference(e) for e in EDGES),
                "reference",
                "edge",
                ["child_rows", "unset_rows", "orphan_keys", "orphan_rows"],
            ),
            _findings(_rules("orders"), "rule", "rule", rules),
            _findings(_rules("lineitem"), "rule", "rule", rules),
            _findings(
                _category_distance("lineitem", "l_returnflag", *STATUS, digits=12),
                "category",
                "'lineitem.l_returnflag by l_linestatus'",
                ["levels", "n_first", "n_second", "total_variation", "chi_square", "degrees"],
            ),
            _findings(
                _ks("lineitem", ["l_quantity"], *STATUS, digits=12),
                "distribution",
                "'lineitem.' || \"column\" || ' by l_linestatus'",
                ["n_first", "n_second", "statistic"],
            ),
            _findings(
                _moments("events", ["value"]),
                "moments",
                "'events.' || \"column\"",
                ["n", "mean", "sd", "skewness", "kurtosis"],
            ),
            _findings(
                _correlations("lineitem", ["l_quantity", "l_extendedprice"], digits=12),
                "correlation",
                '"left" || \'~\' || "right"',
                ["n", "correlation"],
            ),
            _findings(
                _order_summary(*EVENT_ORDER),
                "order",
                "'events by user_id'",
                ["entities", "rows", "gaps", "backward_steps", "shortest_gap_us", "longest_gap_us"],
            ),
        ]
    )


def oracles() -> dict[str, str]:
    deciles = [i / 10 for i in range(11)]
    parts = ("lineitem", "l_partkey", *STATUS)
    flags = ("lineitem", "l_returnflag", *STATUS)
    measures = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return {
        **{f"profile_{table}": _profile(table) for table in COLUMNS},
        "quantiles_lineitem": _quantiles(
            "lineitem", ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount"], deciles
        ),
        "quantiles_events": _quantiles("events", ["value"], [0.01, 0.25, 0.5, 0.75, 0.99]),
        "key_summary": _union(_key_summary(t, k) for t, k in KEYS.items()),
        "key_duplicates_lineitem": _key_duplicates("lineitem", KEYS["lineitem"]),
        "key_duplicates_events_user": _key_duplicates("events", ["user_id"]),
        "references": _union(_reference(e) for e in EDGES),
        "references_unused": _union(_reference(e) for e in UNUSED),
        "orphan_keys_documents": _orphan_keys(UNUSED[3]),
        **{f"rules_{table}": _rules(table) for table in RULES},
        "category_shares_lineitem": _category_shares("lineitem", "l_returnflag", "l_linestatus"),
        "category_shares_documents": _category_shares("documents", "source", "lang"),
        "category_levels_lineitem": _category_levels(*flags),
        "category_levels_parts": _category_levels(*parts),
        "category_distance_lineitem": _category_distance(*flags),
        "category_distance_parts": _category_distance(*parts),
        "category_distance_orders": _category_distance(
            "orders", "o_orderpriority", "o_orderstatus", "F", "P"
        ),
        "ks_lineitem": _ks("lineitem", measures, *STATUS),
        "ks_lineitem_price_by_quantity": _ks(
            AMOUNT, ["l_extendedprice", "l_quantity"], "amount", "small", "large"
        ),
        "ks_orders": _ks("orders", ["o_totalprice"], "o_orderstatus", "F", "P"),
        "ks_events": _ks("events", ["value"], "event_type", "view", "purchase"),
        "moments_lineitem": _moments("lineitem", measures),
        "moments_events": _moments("events", ["value"]),
        "moments_events_by_type": _moments("events", ["value"], ["event_type"]),
        "correlations_lineitem": _correlations("lineitem", [*measures, "l_partkey"]),
        "correlations_events": _correlations("events", ["value", "user_id", "event_id"]),
        "order_gaps_events": _order_gaps(*EVENT_ORDER),
        "order_gaps_orders": _order_gaps(*ORDER_ORDER),
        "order_summary_events": _order_summary(*EVENT_ORDER),
        "order_summary_orders": _order_summary(*ORDER_ORDER),
        "report": _report(),
    }
