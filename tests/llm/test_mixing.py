"""Pareto order sampling against a plain computation, with ids that repeat or are missing."""

import hashlib
import random
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor

import pytest
import xxhash

from plumbline.llm import mixing
from tests.llm.data import word

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint, index string, same int"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hashed(*values):
    h = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else (v % (1 << 64)).to_bytes(8, "little")
        h = xxhash.xxh64(data, seed=h % (1 << 64)).intdigest()
    return signed(h)


@pytest.fixture(scope="module")
def rows():
    chance = random.Random(9)
    out = []
    for source in "abc":
        for i in range(150):
            text = " ".join(word() for _ in range(chance.randint(1, 120)))
            doc_id = {"a": i, "b": 1_000, "c": None}[source]
            out.append((doc_id, text, "x", source, 1, 7, "i", 3))
    same = " ".join(word() for _ in range(50))
    out += [(5_000, same, "x", s, 1, 7, "i", 3) for s in "abc" for _ in range(60)]
    out += [(i, None if i % 2 else " ", "x", None, 1, 7, "i", 3) for i in range(6_000, 6_010)]
    return out


def drawn(rows, targets, most=3):
    """Copies of every row: certain ones, those in Pareto order up to the target, and one that closes the gap."""
    groups, equal = defaultdict(list), Counter()
    for doc_id, text, _, source, *_ in rows:
        key = ("-" if doc_id is None else f"={doc_id}") + ("-" if source is None else f"={source}") + "\n"
        same = hashed(key, *([] if text is None else [text]))
        groups[source].append((len((text or "").split()), hashed(same, equal[same]), doc_id))
        equal[same] += 1
    out = []
    for source, members in groups.items():
        target, digits = targets[source], lambda size: len(f"{size:b}")
        low, high = 0.0, 1e9
        for _ in range(200):  # what all documents are wanted together, by bisection
            c = (low + high) / 2
            total = sum(min(most, c * digits(size)) * size for size, *_ in members)
            low, high = (c, high) if total < target else (low, c)
        left, ranked = target, []
        certain = {}
        for size, key, doc_id in members:
            wanted = min(most, high * digits(size))
            wanted = round(wanted) if abs(wanted - round(wanted)) < 1e-9 else wanted
            certain[key] = floor(wanted)
            left -= certain[key] * size
            if size and (p := wanted - certain[key]):
                u = (int(hashlib.md5(f"mix:{key}".encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)
                ranked.append(((u / (1 - u)) / (p / (1 - p)), key, size))
        ranked.sort()
        extra, at = set(), 0
        while at < len(ranked) and ranked[at][2] <= left:
            extra.add(ranked[at][1])
            left -= ranked[at][2]
            at += 1
        close = [(abs(size - left), rank, key) for rank, key, size in ranked[at:] if abs(size - left) < left]
        if close:
            extra.add(min(close)[2])
        out += [(doc_id, size, size * (certain[key] + (key in extra))) for size, key, doc_id in members]
    return Counter(out)


def test_pareto_order_of_all_rows(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    found = mixing.mix_sources(docs.repartition(7)).collect()
    by_size = {(r.source_size, r.target) for r in found}
    sizes = Counter()
    for _, text, _, source, *_ in rows:
        sizes[source] += len((text or "").split())
    targets = {s: next(t for size, t in by_size if size == n) for s, n in sizes.items()}
    assert Counter((r.doc_id, r["size"], r.taken) for r in found) == drawn(rows, targets)
    assert Counter((r.doc_id, r["size"], r.taken) for r in mixing.mix_sources(docs.coalesce(1)).collect()) == drawn(rows, targets)
    taken = Counter()
    for r in mixing.mixed_documents(docs).collect():
        taken[r.source] += len(r.text.split())
    longest = max(len((r[1] or "").split()) for r in rows)
    for source in "abc":
        assert abs(taken[source] - targets[source]) <= longest


def test_many_sources(spark):
    """Targets of hundreds of sources, some of them empty, against water filling by fractions."""
    chance = random.Random(4)
    rows = [(i, "w " * chance.choice([0, 1, 5, 400]), "x", f"s{i % 300:03}", 1, 7, "i", 3) for i in range(900)]
    size = Counter()
    for _, text, _, source, *_ in rows:
        size[source] += len(text.split())
    order = sorted({r[3] for r in rows})
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    level, full = Fraction(0), set()
    while True:
        left = sum(size.values()) - 3 * sum(size[s] for s in full)
        level = Fraction(left, sum(w for s, w in weight.items() if s not in full))
        more = {s for s in order if level * weight[s] >= 3 * size[s]} | full
        if more == full:
            break
        full = more
    found = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()
    source = {r[0]: r[3] for r in rows}
    for r in found:
        s = source[r.doc_id]
        assert r.target == pytest.approx(float(3 * size[s] if s in full else level * weight[s]))
