"""SQL twins of the operators that SQL can express."""

from __future__ import annotations

from plumbline.llm.common import UPPER

_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _lower(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{UPPER.lower()}')"


# Windows as joined words, every word's place marked by the windows around it.
_DECONTAMINATE = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, {_WORDS}) AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_lower("coalesce(text, '')")}, {_WORDS}) AS w FROM benchmark
), bi AS (
  SELECT item, w, least(10, len(w)) AS n, unnest(range(0, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item, n, array_to_string(list_slice(w, i + 1, i + n), ' ') AS words FROM bi
), di AS (
  SELECT r, w, n, unnest(range(0, greatest(len(w) - n + 1, 0))) AS i FROM d, (SELECT DISTINCT n FROM bw) AS sizes
), dw AS (
  SELECT r, i, n, array_to_string(list_slice(w, i + 1, i + n), ' ') AS words FROM di
), hits AS (
  SELECT r, i, n, item FROM dw JOIN bw USING (n, words)
), places AS (
  SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits) AS x
), covered AS (
  SELECT r, count(*) AS n_hit FROM places GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) AS x GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""


# Host and path as the rules read them; without a rule the url is allowed.
_URLS = f"""
WITH p AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM p
), parts AS (
  SELECT page_id, {_lower("raw")} AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), won AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, verdict,
    row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule_host || rule_path) DESC) AS place
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT page_id, host, path, rule, verdict FROM won WHERE place = 1) AS w USING (page_id, host, path)
"""

# Sets of shingles, pairs by a common one, and all documents that links lead to.
_COMPONENTS = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), i AS (
  SELECT doc_id, w, unnest(range(0, greatest(len(w) - 3, 1))) AS k FROM d WHERE len(w) > 0
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, k + 1, k + 4), ' ') AS shingle FROM i
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id != b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)
), reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.y FROM reached r JOIN links l ON l.x = r.other
)
SELECT doc_id, CAST(coalesce(max(n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id
FROM reached LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


def _merkle(levels: int = 7, arity: int = 8) -> str:
    """Levels of runs written out one by one; enough of them for arity ** levels leaves of a tree."""

    def field(name: str) -> str:
        return f"coalesce(concat(strlen(CAST({name} AS VARCHAR)), ':', CAST({name} AS VARCHAR)), '-')"

    def leaf(text: str) -> str:
        columns = [*(f"CAST({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", "n_chars")), text]
        return "sha256(concat(" + ", ".join(field(c) for c in columns) + "))"

    # CRC-32 bit by bit; only the first of a byte's eight steps takes the byte in.
    steps = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c), 0, 0, 0, 0, 0, 0, 0]))"
    crc = (
        f"xor(4294967295, list_reduce(list_prepend(4294967295, CAST({steps} AS BIGINT[])), "
        "lambda c, b: xor(xor(c, b) // 2, 3988292384 * (xor(c, b) % 2))))"
    )
    parts = [
        f"d AS (SELECT row_number() OVER () AS r, doc_id, lang, {leaf('text')} AS leaf, "
        f"CASE WHEN {crc} % 3 = 0 THEN {leaf(_lower('text'))} ELSE {leaf('text')} END AS found FROM documents)",
        "o AS (SELECT r, doc_id, leaf, found, coalesce('=' || lang, '-') AS tree, "
        "row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d)",
        "n0 AS (SELECT tree, i, n, leaf AS h FROM o)",
    ]

    def tree(name: str, depth: int) -> None:
        for k in range(1, depth + 1):
            below = f"{name}{k - 1}"
            parts.append(
                f"{name}r{k} AS (SELECT tree, i // {arity} AS i, list(h ORDER BY i) AS hs, max(n) AS n FROM {below} WHERE n > 1 GROUP BY tree, i // {arity})"
            )
            parts.append(
                f"{name}{k} AS (SELECT tree, i, (n + {arity - 1}) // {arity} AS n, sha256(array_to_string(hs, '')) AS h FROM {name}r{k} "
                f"UNION ALL SELECT tree, i, n, h FROM {below} WHERE n = 1)"
            )

    tree("n", levels)
    parts.append(
        f"t0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n, h, tree AS lang FROM n{levels})"
    )
    tree("t", 2)
    # Each leaf climbs: what its run holds before and behind it is its proof on that level.
    parts.append(
        "c0 AS (SELECT o.r, o.doc_id, o.leaf, o.found, o.tree, o.i AS i, '' AS proof, s.h AS subroot, q.h AS root, s.i AS place "
        "FROM o JOIN t0 s ON s.lang = o.tree CROSS JOIN (SELECT h FROM t2) q)"
    )
    climbs = [("n", k, "c.tree", "c.i") for k in range(1, levels + 1)] + [("t", k, "''", "c.place") for k in (1, 2)]
    for step, (name, k, key, at) in enumerate(climbs):
        index = f"{at} // {arity ** (k - 1)}"
        slot = f"CAST(({index}) % {arity} AS INTEGER)"
        before = f"array_to_string(list_slice(x.hs, 1, {slot}), '')"
        behind = f"array_to_string(list_slice(x.hs, {slot} + 2, {arity}), '')"
        parts.append(
            f"c{step + 1} AS (SELECT c.r, c.doc_id, c.leaf, "
            f"CASE WHEN x.hs IS NULL THEN c.found ELSE sha256(concat({before}, c.found, {behind})) END AS found, "
            f"c.tree, c.i, CASE WHEN x.hs IS NULL THEN c.proof ELSE concat(c.proof, {before}, {behind}) END AS proof, "
            f"c.subroot, c.root, c.place FROM c{step} c LEFT JOIN {name}r{k} x ON x.tree = {key} AND x.i = {at} // {arity ** k})"
        )
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, "
        f"found AS folded_root, found = root AS verified FROM c{len(climbs)}"
    )


def oracles() -> dict[str, str]:
    return {
        "op6_url_filter": _URLS,
        "op7_jaccard_join": _COMPONENTS,
        "op11_decontaminate": _DECONTAMINATE,
        "op13_merkle": _merkle(),
    }
