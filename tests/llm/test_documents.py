"""Operators on documents against plain computations, on awkward and on empty tables."""

import os
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import components, jaccard_join, language, licenses, line_dedup, mixing, packing, quality
from plumbline.llm.common import materialize
from plumbline.llm.components import connected_components
from plumbline.llm.packing_plan import plan_packing
from tests.llm.data import DOCS, documents

GAP = re.compile("[\x20\x09-\x0d]+")


def words(text):
    return [w for w in GAP.split(text or "") if w]


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text, n):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80), (2, 50)])
def test_near_duplicates_lose_no_link(docs, rows, n, percent):
    found = jaccard_join.near_duplicates(docs, jaccard_join.Rule(n, percent)).collect()
    sets = [(r[0], shingles(r[1], n)) for r in rows if r[0] is not None]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, x), (j, y) in combinations(sets, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    known = Counter((i, len(s), root(i)) for i, s in sets)
    assert Counter(tuple(r) for r in found if r["doc_id"] is not None) == known
    assert len(found) == len(rows)


def test_near_duplicates_of_a_large_cluster(spark, monkeypatch):
    """Many texts of which each pair differs a little: one component, far from all pairs."""
    base = documents()[6][1].split(" ")
    texts = [(i, " ".join([*base[:40], f"w{i}", *base[41:]])) for i in range(300)]
    tried = []
    verify = jaccard_join._verify

    def counted(texts, pairs, rule):
        tried.append(pairs.count())
        return verify(texts, pairs, rule)

    monkeypatch.setattr(jaccard_join, "_verify", counted)
    found = jaccard_join.near_duplicates(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    assert {r["component_id"] for r in found} == {0}
    assert sum(tried) < 300 * 40


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (5, 5), (None, 4), (3, 1), (20, 10), *[(i, i + 1) for i in range(100, 180)]]
    found = connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {(r[0], r[1]) for r in found} == {(2, 1), (3, 1), (9, 8), (20, 10), *[(i, 100) for i in range(101, 181)]}


def tasks_of(spark, group, work):
    """How many tasks the jobs of ``work`` have run."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
    return sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))


def test_components_take_few_tasks(spark):
    """A round has three shuffles, one read twice: the driver keeps a record of every task of every stage."""
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 9)], "a bigint, b bigint").coalesce(1)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = materialize(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        found = []
        run = lambda: found.extend(components._small_star(components._large_star(edges)).collect())
        assert tasks_of(spark, "one round of components", run) < 5 * 40
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert {u for u, _ in found} == set(range(2, 10)) and len(set(found)) == len(found) and all(u > v for u, v in found)


def test_weights_are_one_constant(spark):
    """An array of a literal for each bucket would be copied and rewritten with every rule of the plan."""
    values = [0.0, -0.0, 1e-06, -1.5, 12.345678] * 2_000
    table = spark.range(1).select(quality.Weights(values).column().alias("table"))
    assert table._jdf.queryExecution().analyzed().expressions().head().collectLeaves().size() < 10
    assert table.first().table == values


def repeated_words(w):
    windows = defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i : i + 8])].append(i)
    return len({j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)})


def test_quality_counts_and_verdict(spark, docs, rows, empty):
    trusted = spark.createDataFrame([(6,), (19,), (20,), (21,)], "doc_id bigint")
    weights = quality.fit_weights(docs, trusted, buckets=64)
    found = {r["doc_id"]: r for r in quality.score_quality(docs, weights).collect()}
    for i, text, *_ in rows:
        w, r, lines = words(text), found[i], [x for x in (text or "").split("\n") if words(x)]
        again = repeated_words(w)
        assert (r.n_words, r.word_chars) == (len(w), sum(map(len, w)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text or "")
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), again)
        assert r.base_failed == (len(w) < 20 or 100 * again > 30 * len(w))
        assert r.kept == (not r.base_failed and r.llr >= -0.08)
    kept = quality.keep_good(docs, weights)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(x[0]) for x in rows if found[x[0]].kept)
    assert set(quality.fit_weights(empty, trusted, buckets=8).values) == {0.0}
    assert quality.score_quality(empty, weights).count() == 0


def test_quality_trusts_good_labels(spark):
    labels = [(1, 1, 0), (2, 1, 1), (3, 0, 0), (4, 1, None), (None, 1, 0), (1, 1, 0)]
    found = quality.trusted_ids(spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    assert {r[0] for r in found} == {1, 4} and len(found) == 2


def test_mix_meets_its_targets(docs, rows, empty):
    found = mixing.mix_sources(docs).collect()
    assert len(found) == len(rows)
    size = Counter()
    for i, text, _, source, *_ in rows:
        size[source] += len(words(text))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = sum(size.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 3 * size[s]]
        for s in over or open_:
            target[s] = 3 * size[s] if over else level * weight[s]
        if not over:
            break
        left -= sum(3 * size[s] for s in over)
        open_ -= set(over)
    source = {r[0]: r[3] for r in rows}
    taken = Counter()
    for r in found:
        s = source[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(target[s])
        assert r.taken <= 3 * r["size"] and (r.taken % r["size"] == 0 if r["size"] else r.taken == 0)
        taken[s] += r.taken
    longest = {s: max(len(words(r[1])) for r in rows if r[3] == s) for s in size}
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in size)
    again = sorted(map(tuple, mixing.mix_sources(docs.repartition(5)).collect()), key=repr)
    assert again == sorted(map(tuple, found), key=repr)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(words(r.text)) for r in mixed.collect()) == sum(taken.values())
    assert mixing.mix_sources(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_packing_round_trip(docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = packing.pack_documents(docs).collect()
    pieces = Counter()
    for i, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            pieces[(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in found) == pieces
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        assert [o for o, _ in sorted(held)] == [0, *np.cumsum([n for _, n in sorted(held)])[:-1]]
        assert sum(n for _, n in held) <= 1024
    assert len(sequences) <= -(-sum(r.length for r in found) // 1024) + 1
    assert packing.pack_documents(empty).count() == 0


@pytest.mark.parametrize("counts", [{}, {1: 5}, {1024: 3}, {600: 10, 424: 10}, {300: 1000}, {n: n % 7 for n in range(1, 1025)}])
def test_packing_plan_places_every_rank_once(counts):
    plan = plan_packing(counts, 1024)
    held, ranks = defaultdict(list), Counter()
    for length, rank, n, sequence, offset in plan.placements:
        for i in range(n):
            held[sequence + i].append((offset, length))
            ranks[(length, rank + i)] += 1
    assert ranks == Counter({(length, i): 1 for length, n in counts.items() for i in range(n)})
    for pieces in held.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(held) == plan.sequences


def test_language_held_out(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = language.fit(docs.where("doc_id % 4 != 2"))
    found = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("doc_id % 4 = 2").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.98 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_of_awkward_texts(docs, rows, empty):
    model = language.fit(docs)
    found = language.identify(docs, model).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    for i, text, *_ in rows:
        assert by_id[i].lang_pred == ("xx" if any(c.isalpha() for c in text or "") else "und")
    nothing = language.identify(docs, language.fit(empty)).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    assert language.identify(empty, model).count() == 0


def test_language_rejects_what_is_far(spark):
    texts = [(i, "le la les des " * 9 + str(i), "fr") for i in range(20)] + [(99, "Привет мир", None)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, lang string")
    found = {r.doc_id: r for r in language.identify(docs, language.fit(docs)).collect()}
    assert found[99].rejected and not found[3].rejected


LINES = [
    "Released under, THE mit-License!", "all rights\treserved", "Licensed under the Apache License, Version 2.0. Apache license version 2",
    "cc by nc cc.by.nc", "Licensed under CC BY-NC 4.0", "nothing here", "under the mit", "license", "Copyright; All Rights Reserved",
]


def test_licenses_against_all_templates(spark, docs, rows, empty):
    texts = [(i, "\n".join(LINES[i % 3 :: 1 + i % 4]), 1) for i in range(12)] + [(50, None, 1), (51, "", 1)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string, labels int")
    found = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    for i, text, _ in texts:
        held = licenses.words(text or "")
        places, base = [], set()
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            at = [k for k in range(len(held)) if held[k : k + len(p)] == p]
            places += at
            base |= {label} if at else set()
        labels, best = set(base), 1.0 if base else 0.0
        for line in (text or "").split("\n"):
            block = set(licenses.words(line))
            for label, template in licenses.TEMPLATES:
                t = set(licenses.words(template))
                if 100 * len(t & block) >= 90 * len(t):
                    labels.add(label)
                    best = max(best, len(t & block) / len(t))
        r = found[i]
        assert (r.n_words, r.n_base) == (len(held), len(places))
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None))
        assert (r.base_labels, r.labels) == (",".join(sorted(base)), ",".join(sorted(labels)))
        assert r.score == pytest.approx(best)
    assert licenses.scan_licenses(docs).count() == len(rows)
    assert licenses.scan_licenses(empty).count() == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files, to deal in the Software"""
BSD = """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are met:"""


def test_licenses_across_lines_but_not_scattered(spark):
    scattered = "all of it " + "word " * 500 + "rights " + "word " * 500 + "reserved " + "word " * 9
    texts = [
        f"x\n\n{MIT}", BSD, f"{MIT}\n{BSD}\nand\n{MIT}", scattered, scattered + "\nAll\nrights\nreserved.", MIT.replace(" ", "\n"),
        "all rights " * 3 + "reserved reserved all all", "a word of all the\nrights that are\nnow reserved",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: [(b.line, b.label, b.containment) for b in r.blocks] for r in licenses.scan_licenses(docs).collect()}
    assert found[0] == [(2, "mit", 1.0)] and found[1] == [(0, "bsd", 1.0)] and found[5] == [(0, "mit", 1.0)]
    assert found[2] == [(0, "mit", 1.0), (2, "bsd", 1.0), (5, "mit", 1.0)]
    assert found[3] == [] and found[4] == [(1, "all-rights-reserved", 1.0)]
    assert found[6] == [(0, "all-rights-reserved", 1.0)] and found[7] == []


def test_license_blocks_against_all_stretches():
    """Templates found at random places, by looking at every stretch of words."""
    rng = np.random.default_rng(3)
    scan = licenses.Scan(templates=[("x", "a b c d e f g h i j k"), ("y", "a l m"), ("z", "b b c n")], phrases=[])
    scanner = licenses.Scanner(scan, {"a": 9, "b": 5, "l": 1})
    hits = 0
    for _ in range(400):
        w = list(rng.choice(list("abcdefghijklmn") + ["o"] * int(rng.integers(1, 9)), size=rng.integers(0, 60)))
        expected = set()
        for label, template in scan.templates:
            t, n = set(template.split()), 2 * len(template.split())
            if any(10 * len(t & set(w[i : i + n])) >= 9 * len(t) for i in range(max(1, len(w) - n + 1))):
                expected.add(label)
        text = "".join(x + str(rng.choice([" ", "\n"])) for x in w)
        assert set(filter(None, scanner.scan(text)[5].split(","))) == expected
        hits += len(expected)
    assert hits > 50


def test_line_dedup_keeps_the_first(docs, rows, empty):
    rule = line_dedup.Chunks()
    found = line_dedup.dedup_lines(docs, rule).collect()
    assert len(found) == len(rows)
    places = defaultdict(set)
    for i, text, *_ in rows:
        for k, lines in enumerate(line_dedup._split(text, rule)):
            if sum(len(x.split()) for x in lines) >= (rule.words if len(lines) > 1 else rule.passage):
                places["\n".join(lines)].add(((i is not None, i or 0), k))
    expected = {}
    for i, text, *_ in rows:
        kept = []
        for k, lines in enumerate(line_dedup._split(text, rule)):
            at = places.get("\n".join(lines), set())
            gone = i is not None and len(at) > 1 and min(at) != ((True, i), k)
            kept += [] if gone else lines
        expected[i] = None if text is None else "\n".join(kept)
    assert {r.doc_id: r.text for r in found} == expected
    assert sum(r.n_removed_chunks for r in found) > 0
    for r in found:
        assert r.n_lines - r.n_removed_lines == (0 if r.text is None else len(r.text.split("\n")) if r.text or not r.n_removed_lines else 0)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_chunks_resist_shifts():
    passage = [f"line {i} of a passage" for i in range(40)]
    rule = line_dedup.Chunks()
    cut = [{"\n".join(c) for c in line_dedup._split("\n".join([*before, *passage]), rule)} for before in ([], ["x"], ["y", "z", "w"])]
    assert len(cut[0] & cut[1] & cut[2]) >= len(cut[0]) - 4


def test_line_dedup_cuts_a_passage_of_one_line(spark):
    passage, short = (" ".join(f"{w}{i}" for i in range(n)) for w, n in (("long", 50), ("short", 49)))
    texts = [f"a b\n{passage}\nc", f"{short}\nd", f"e\n{passage}", f"f\n\n{short}\ng h", passage]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert found == {0: texts[0], 1: texts[1], 2: "e", 3: texts[3], 4: ""}


def without_passages(texts, least=50):
    """Lines of every run that stands in an earlier place, by comparing all pairs of lines."""
    lines = [t.split("\n") for t in texts]
    gone = [set() for _ in lines]
    for d, x in enumerate(lines):
        for e, y in enumerate(lines[: d + 1]):
            for i in range(len(x)):
                for j in range(len(y) if e < d else i):
                    if i and j and x[i - 1] == y[j - 1]:
                        continue
                    n = 0
                    while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                        n += 1
                    if sum(len(z.split()) for z in x[i : i + n]) >= least:
                        gone[d].update(range(i, i + n))
    return ["\n".join(z for i, z in enumerate(x) if i not in g) for x, g in zip(lines, gone)]


def test_line_dedup_cuts_passages_of_few_lines(spark):
    """Passages of two to five lines among other lines, each in three documents."""
    n = iter(range(10**6))

    def line(size):
        return " ".join(f"w{next(n)}" for _ in range(size))

    texts = []
    for size in (2, 3, 4, 5):
        for _ in range(12):
            passage = [line(-(-50 // size)) for _ in range(size)]
            texts += ["\n".join([*map(line, (7, 9, 12)[:k]), *passage, *map(line, (8, 11)[: 2 - k])]) for k in range(3)]
    run = [line(20) for _ in range(9)]
    texts += ["\n".join([*run[:7], line(9)]), "\n".join([line(6), *run[2:]]), "\n".join([line(5), *run, line(4)])]
    short = [line(24), line(25)]
    texts += ["\n".join([line(9), *short]), "\n".join([*run[:2], *short])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    # No line or pair of lines is worth a chunk, so that passages alone are cut.
    rule = line_dedup.Chunks(words=50)
    found = {r.doc_id: r for r in line_dedup.dedup_lines(docs, rule, passages=True).collect()}
    assert [found[i].text for i in range(len(texts))] == without_passages(texts)
    assert sum(r.n_removed_lines for r in found.values()) > 24 * 14
    assert sum(line_dedup.dedup_lines(docs, rule).toPandas().n_removed_lines) < 24 * 14


def test_line_dedup_keeps_one_of_overlapping_passages(spark):
    same, (a, b, c) = "w " * 20, ("a " * 30, "b " * 30, "c " * 30)
    texts = ["\n".join([same] * 9), "\n".join([a, b, c] * 3), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rule = line_dedup.Chunks(words=50)
    found = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, rule, passages=True).collect()}
    assert found[0] == "\n".join([same] * 3) and found[1] == "\n".join([a, b, c]) and (found[2], found[3]) == (None, "")


def test_line_dedup_counts_documents_without_id(spark):
    """A chunk in a document with an id and one without: the latter is the first and stays."""
    text = "\n".join(f"line {i} of a text that stands twice" for i in range(12))
    docs = spark.createDataFrame([(1, text), (None, text)], "doc_id bigint, text string")
    for passages in (False, True):
        found = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, passages=passages).collect()}
        assert found[None] == text and len(found[1]) < len(text) / 2
