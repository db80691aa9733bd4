"""Benchmark decontamination against a plain computation."""

import hashlib
import random
import re
from collections import Counter

import pytest

from plumbline.llm import decontaminate
from plumbline.llm.decontaminate import Windows
from plumbline.llm.oracles import oracles
from plumbline.llm.queries import op11_decontaminate
from tests.llm.data import DOCS, documents, prose
from tests.oracle import connect, spark_rows, sql_rows

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ITEMS = "item_id bigint, text string, doc_id bigint, words string, hits string"


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def tables():
    chance = random.Random(3)
    rows = documents()
    long = words(rows[14][1])  # 20,000 words
    texts = [" ".join(long[k : k + 40]) for k in (0, 500, 19_960)]
    texts += [" ".join(long[5_000:7_000]), "One, two THREE", "same " * 12, "é ü ñ " * 4, "emoji", None, "", "?! -", prose(30), texts[0], texts[1].upper()]
    items = [(i, t) for i, t in enumerate(texts)] + [(None, texts[2]), (3, " ".join(long[9_000:9_011])), (100, rows[6][1]), (20, rows[6][1])]
    for k in range(20):
        start = chance.randrange(15_000)
        cut = long[start : start + chance.randint(8, 14)]
        rows.append((1_000 + k, f"{prose(5)} {' '.join(cut)}, {prose(4)} {' -- '.join(cut).title()}", None, None, None, 7, "c", "i", "s"))
    return rows, [(*item, 1, "w", "h") for item in items]


def expected(rows, items, size):
    windows = {}
    for item, text, *_ in items:
        w = words(text)
        for i in range(max(len(w) - size + 1, 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text, *_ in rows:
        w, hit, named = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    named.update(str(x) for x in found if x is not None)
        digest = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(named), digest, bool(hit)))
    return Counter(out)


@pytest.mark.parametrize("windows", [Windows(), Windows(words=3), Windows(block_words=1_000)])
def test_contamination(spark, tables, windows):
    rows, items = tables
    docs, bench = spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)
    found = decontaminate.contamination(docs, bench, windows)
    assert found.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = Counter(tuple(r) for r in found.collect())
    assert got == expected(rows, items, windows.words)
    assert sum(r[-1] for r in got) > 10


def test_windows_cross_no_end_of_a_text(spark):
    items = [(1, "a b c d e f g h i j k", 0, "", ""), (2, "x y", 0, "", "")]
    rows = [(1, "a b c d e f"), (2, "g h i j k x"), (3, "y"), (4, "x, y"), (5, "k j " + "a b c d e f g h i j")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    found = decontaminate.contamination(docs, spark.createDataFrame(items, ITEMS)).collect()
    assert {r.doc_id: r.n_hit for r in found} == {1: 0, 2: 0, 3: 0, 4: 2, 5: 10}


def test_chunks_of_a_long_text(monkeypatch, spark):
    monkeypatch.setattr(decontaminate, "_CHUNK", 7)
    lookup = decontaminate._Lookup([("a b c d e f g h i j".split(), ["1"]), (["longer", "é"], ["2"])], 10)
    text = "longerlonger A b,c d e f g h i j\n longer é " * 3
    assert decontaminate._hits([lookup.word_ids(text.encode())], lookup)[0] == {
        "n_words": 39, "spans": [{"first": 1 + 13 * i, "stop": 13 + 13 * i} for i in range(3)], "items": ["1", "2"],
    }


@pytest.mark.parametrize("windows", [Windows(), Windows(block_words=1_000)])
def test_what_is_removed(spark, tables, windows):
    rows, items = tables
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS)
    hit = {r[0] for r in expected(rows, items, 10) if r[-1]}
    clean = decontaminate.decontaminate(docs, bench, windows, remove="documents")
    assert clean.columns == docs.columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(r[0] for r in rows if r[0] not in hit)
    cut = decontaminate.decontaminate(docs, bench, windows)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    texts = {r[0]: r[1] for r in rows}
    left = {r.doc_id: r.text for r in cut.collect()}
    assert all(left[i] == t for i, t in texts.items() if i not in hit)
    for doc, n, n_hit, *_ in expected(rows, items, 10):
        assert len(words(left[doc])) == n - n_hit
    with pytest.raises(ValueError):
        decontaminate.decontaminate(docs, bench, remove="lines")


def test_cut_runs_leave_the_rest(spark):
    items = [(1, "a b c d e f g h i j k", 0, "", "")]
    docs = spark.createDataFrame([(1, "Ä start! A b, c\nd e f g h i j K; end."), (2, None), (3, "")], "doc_id bigint, text string")
    left = decontaminate.decontaminate(docs, spark.createDataFrame(items, ITEMS)).collect()
    assert {r.doc_id: r.text for r in left} == {1: "Ä start! ; end.", 2: None, 3: ""}


def test_empty_tables(spark, tables):
    rows, items = tables
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS)
    no_docs, no_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    for windows in (Windows(), Windows(block_words=1_000)):
        assert decontaminate.contamination(no_docs, bench, windows).count() == 0
        assert decontaminate.decontaminate(no_docs, bench, windows).count() == 0
    assert decontaminate.contamination(docs, no_items).where("contaminated OR n_hit > 0 OR n_items > 0").count() == 0


def test_same_as_sql(spark, folder):
    found = spark_rows(op11_decontaminate(spark, folder))
    assert found == sql_rows(connect(folder), oracles()["op11_decontaminate"])
