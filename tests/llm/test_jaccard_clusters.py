"""Near copies in large clusters: linear work, and no link lost."""

import random
from collections import Counter
from itertools import combinations

from plumbline.llm import jaccard_join
from plumbline.llm.jaccard_join import Rule, near_duplicates
from plumbline.llm.oracles import oracles
from plumbline.llm.queries import op7_jaccard_join
from tests.llm.data import DOCS, word
from tests.oracle import connect, spark_rows, sql_rows


def cluster(n, length, edits, seed):
    """Copies of one text with some words changed: many pairs near the threshold, on both sides."""
    chance = random.Random(seed)
    base = [word() for _ in range(length)]
    texts = []
    for i in range(n):
        own = list(base)
        for at in chance.sample(range(length), chance.randint(0, edits)):
            own[at] = f"w{chance.randrange(10**6)}"
        texts.append(" ".join(own))
    return texts


def components(texts, rule):
    sets = []
    for text in texts:
        w = text.split()
        sets.append({tuple(w[i : i + rule.words]) for i in range(len(w) - rule.words + 1)})
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in combinations(range(len(sets)), 2):
        common = len(sets[i] & sets[j])
        if 100 * common >= rule.percent * (len(sets[i]) + len(sets[j]) - common):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))]


def test_a_large_cluster_is_tried_in_linear_work(spark, monkeypatch):
    tried = []
    verify = jaccard_join._compared

    def counted(texts, pairs, rule):
        tried.append(pairs.count())
        return verify(texts, pairs, rule)

    monkeypatch.setattr(jaccard_join, "_compared", counted)
    monkeypatch.setattr(jaccard_join, "CROWD", 32)
    texts = cluster(1_000, 100, 4, 1) + cluster(100, 60, 6, 2)
    rule = Rule(4, 85)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    found = {r.doc_id: r.component_id for r in near_duplicates(df, rule).collect()}
    assert [found[i] for i in range(len(texts))] == components(texts, rule)
    # All pairs would be half a million, and those of common shingles hardly fewer.
    assert sum(tried) < 60 * len(texts)


def test_classes_are_more_than_their_key(spark, monkeypatch):
    """Sets whose keys collide stay apart and keep their own links."""
    monkeypatch.setattr(jaccard_join, "_class_key", lambda found: len(found) % 2)
    texts = cluster(40, 50, 3, 5) + [cluster(1, 30, 0, i)[0] for i in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(99, texts[3])], "doc_id bigint, text string")
    rule = Rule(4, 85)
    found = {r.doc_id: r.component_id for r in near_duplicates(df, rule).collect()}
    expected = components(texts, rule)
    assert [found[i] for i in range(len(texts))] == expected and found[99] == expected[3]


def test_empty_and_wordless_tables(spark):
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, None), (2, " \n"), (3, ""), (None, None)]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter(tuple(r) for r in found) == Counter([(1, 0, 1), (2, 0, 2), (3, 0, 3), (None, 0, None)])


def test_same_as_sql(spark, folder):
    assert spark_rows(op7_jaccard_join(spark, folder)) == sql_rows(connect(folder), oracles()["op7_jaccard_join"])
