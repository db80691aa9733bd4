"""The packing plan against best fit alone and the least possible, and token ids against the tokenizers file."""

import random
import tracemalloc
import unicodedata
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest

from plumbline.llm import packing
from plumbline.llm.packing_plan import _best_pattern, _groups, _Packer, _patterns, plan_packing
from plumbline.llm.tokens import encoder


def best_fit(counts, capacity):
    packer = _Packer(counts, capacity)
    packer.best_fit()
    return packer.plan.sequences


def drawn(seed, n):
    chance = random.Random(seed)
    shapes = {
        0: lambda: chance.randint(1, 1024),
        1: lambda: min(1024, int(chance.lognormvariate(5.5, 0.8)) + 1),
        2: lambda: chance.choice([300, 340, 341, 342, 512, 513, 700, 1024]),
        3: lambda: chance.randint(257, 500),
        4: lambda: chance.randint(1, 60),
    }
    return Counter(shapes[seed % 5]() for _ in range(n))


@pytest.mark.parametrize("seed", range(5))
@pytest.mark.parametrize("n", [1, 700, 20_000])
def test_plan_places_every_piece_and_wastes_little(seed, n):
    counts = drawn(seed, n)
    plan = plan_packing(counts, 1024, groups=200)
    held = defaultdict(list)
    ranks = defaultdict(list)
    for length, first, times, sequence, offset in plan.placements:
        ranks[length].append((first, times))
        for i in range(times):
            held[sequence + i].append((offset, length))
    for length, found in ranks.items():
        found.sort()
        assert [f for f, _ in found] == [sum(t for _, t in found[:i]) for i in range(len(found))]
        assert sum(t for _, t in found) == counts[length]
    assert set(ranks) == set(counts) and set(held) == set(range(plan.sequences))
    for pieces in held.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(x for _, x in pieces[:i]) for i in range(len(pieces))]
        assert sum(x for _, x in pieces) <= 1024
    assert -(-sum(k * m for k, m in counts.items()) // 1024) <= plan.sequences <= best_fit(counts, 1024)


def test_given_lengths_take_no_more_than_best_fit(spark, folder):
    docs = spark.read.parquet(folder.replace("0.001", "0.01") + "/documents.parquet")
    lengths = [r.length for r in packing.pack_documents(docs).select("length").collect()]
    counts = Counter(lengths)
    least = -(-sum(lengths) // 1024)
    plan = plan_packing(counts, 1024)
    assert least <= plan.sequences <= best_fit(counts, 1024) <= least + 2


@pytest.mark.parametrize("seed", range(20))
def test_best_pattern_of_all(seed):
    random_ = np.random.default_rng(seed)
    size = np.sort(random_.choice(np.arange(257, 1024), 12, replace=False))[::-1]
    prices = random_.uniform(0, 1, 12)
    column = _best_pattern(size, prices, 1024)
    assert column @ size <= 1024
    best = 0.0
    for some in product(range(-1, 12), repeat=3):
        some = [i for i in some if i >= 0]
        if size[some].sum() <= 1024:
            best = max(best, prices[some].sum())
    assert prices @ column == pytest.approx(best)


def test_the_programme_saves_what_best_fit_wastes():
    """Pieces of 257 to 500 tokens: three to a sequence only if well chosen."""
    counts = drawn(3, 20_000)
    assert plan_packing(counts, 1024).sequences < 0.95 * best_fit(counts, 1024)


def test_patterns_use_no_more_than_there_is():
    counts = drawn(0, 5_000)
    long_ = [(length, n) for length, n in sorted(counts.items(), reverse=True) if 256 < length < 1024]
    sizes, members = _groups(long_, 50)
    demand = [sum(n for _, n in m) for m in members]
    used = Counter()
    for pattern, times in _patterns(sizes, demand, 1024):
        assert sum(sizes[j] * n for j, n in pattern.items()) <= 1024
        for j, n in pattern.items():
            used[j] += n * times
    assert all(used[j] <= demand[j] for j in range(len(sizes))) and sum(used.values()) > 0.9 * sum(demand)


def test_token_ids_of_any_text():
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = encoder(None)
    chance = random.Random(12)
    parts = [chr(c) for c in range(0x20, 0x3000, 7)] + [" ", "  ", "\n", "\t", "\r\n", " ", " ", "'s", "'LL", "<|endoftext|>", "1234", "é", "é", "😀", "\U000e0001", "\x00"]
    parts = [p for p in parts if unicodedata.category(p[0]) != "Cs"]
    for _ in range(800):
        text = "".join(chance.choice(parts) * chance.choice([1, 1, 1, 2, 5]) for _ in range(chance.randint(0, 40)))
        assert np.frombuffer(encode(text), dtype="<u4").tolist() == reference.encode(text, add_special_tokens=False).ids


def test_what_an_encoder_remembers_goes_with_it():
    """A worker that has encoded texts keeps the vocabulary, not their words."""
    encoder(None)("some words")  # loads the vocabulary
    texts = [" ".join(f"w{i}x{j}" for i in range(100)) for j in range(300)]
    tracemalloc.start()
    try:
        start = tracemalloc.get_traced_memory()[0]
        encode = encoder(None)
        for text in texts:
            encode(text)
        held = tracemalloc.get_traced_memory()[0] - start
        del encode
        left = tracemalloc.get_traced_memory()[0] - start
    finally:
        tracemalloc.stop()
    assert held > 2_000_000 and left < held / 10
