"""Merkle manifests against a plain computation."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.llm import merkle
from plumbline.llm.oracles import oracles
from plumbline.llm.queries import op13_merkle
from tests.llm.data import DOCS, documents
from tests.oracle import connect, spark_rows, sql_rows


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    fields = [None if x is None else str(x) for x in (doc_id, source, lang, n_chars, text)]
    return h(*["-" if f is None else f"{len(f.encode())}:{f}" for f in fields])


def climb(digests, arity):
    """Root, and for every place the steps (before, after) up to it."""
    levels = [digests]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i : i + arity]) for i in range(0, len(below), arity)])
    paths = []
    for i in range(len(digests)):
        path = []
        for level in levels[:-1]:
            start = i - i % arity
            run = level[start : start + arity]
            path.append(("".join(run[: i - start]), "".join(run[i - start + 1 :])))
            i //= arity
        paths.append(path)
    return levels[-1][0], paths


def expected(rows, arity=8):
    trees = defaultdict(list)
    for doc_id, text, lang, source, n_chars, *_ in rows:
        found = text
        if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
            found = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        leaf = leaf_of(doc_id, text, lang, source, n_chars)
        trees[lang].append((doc_id is not None, doc_id or 0, leaf, doc_id, leaf_of(doc_id, found, lang, source, n_chars)))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {x: climb([r[2] for r in sorted(trees[x], key=lambda r: r[:3])], arity) for x in langs}
    root, above = climb([built[x][0] for x in langs], arity) if langs else (None, [])
    out = []
    for x, up in zip(langs, above):
        for (_, _, leaf, doc_id, found), path in zip(sorted(trees[x], key=lambda r: r[:3]), built[x][1]):
            proof = h(*[b + a for b, a in path + up])
            for before, after in path + up:
                found = h(before, found, after)
            out.append((doc_id, leaf, built[x][0], root, proof, found, found == root))
    return Counter(out)


def given(docs, arity=8):
    """As the query does it, over any table and arity."""
    fields = {name: F.col(name) for name in merkle.FIELDS}
    lower = merkle.digest_of((fields | {"text": F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")}).values())
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    payload = {"doc_id": F.col("doc_id"), "found": F.when(touched, lower)}
    built = merkle.build(docs, merkle.digest_of(fields.values()), F.col("lang"), F.col("doc_id"), payload, arity)
    fold = merkle.folded(F.coalesce("found", "leaf"), F.col("path"))
    rows = built.proofs().select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")), fold, fold == F.col("root"))
    return built, Counter(tuple(r) for r in rows.collect())


@pytest.mark.parametrize("arity", [8, 2, 3])
def test_manifest(spark, arity):
    chance = random.Random(arity)
    rows = [(*r[:2], chance.choice(["en", "en", "en", None, "é", "Z", ""]), *r[3:]) for r in documents()]
    rows += [(10**12, "alone", "lone", None, None, 7, "c", "i", "s"), *[(900 + i, "Capital É", "en", "a", 9, 7, "c", "i", "s") for i in range(12)]]
    rows += [*[(None, "Same", "en", "a", 4, 7, "c", "i", "s")] * 20]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    built, got = given(docs, arity)
    assert got == expected(rows, arity)
    assert {r[-1] for r in got} == {True, False}
    nodes = built.nodes().collect()
    assert len({(r.tree, r.level, r["index"]) for r in nodes if r.tree is not None}) == sum(r.tree is not None for r in nodes)
    top = max((r for r in nodes if r.tree is None and r.digest in {g[3] for g in got}), key=lambda r: r.level)
    assert (top["index"], top.digest) == (0, next(iter(got))[3])


@pytest.mark.parametrize("n", [0, 1, 8, 65])
def test_sizes_of_one_tree(spark, n):
    rows = [(i * 3, f"Text {i}", "en", "s", i, 7, "c", "i", "s") for i in range(n)]
    _, got = given(spark.createDataFrame(rows, DOCS))
    assert got == expected(rows)


def test_many_groups(spark):
    """More groups than a run holds; a tree of several levels above the trees."""
    rows = [(i, f"T{i}", f"g{i % 70}", None, None, 7, "c", "i", "s") for i in range(150)]
    _, got = given(spark.createDataFrame(rows, DOCS))
    assert got == expected(rows)


def test_any_change_changes_the_root(spark):
    rows = documents()
    roots = set()
    for change in (None, 20):
        now = [(*r[:1], (r[1] or "") + "." if i == change else r[1], *r[2:]) for i, r in enumerate(rows)]
        _, got = given(spark.createDataFrame(now, DOCS))
        roots |= {g[3] for g in got}
    assert len(roots) == 2


def test_same_as_sql(spark, folder):
    assert spark_rows(op13_merkle(spark, folder)) == sql_rows(connect(folder), oracles()["op13_merkle"])
