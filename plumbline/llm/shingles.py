"""Word shingles of texts as sets of 64-bit hashes, computed for many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
# One random 64-bit number per byte value.
_BYTE = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = _BYTE[_LOWER]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
BLOCK_BYTES = 500_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, dtype=np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


class WordHasher:
    """Hashes of the words of a block of texts, by running sums over its bytes."""

    def __init__(self) -> None:
        self.powers = self.inverse = np.ones(0, dtype=np.uint64)

    def words(self, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The hash of every word, and the number of words of every text."""
        data = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
        if len(data) > len(self.powers):
            self.powers, self.inverse = _powers(_BASE, len(data)), _powers(_BASE_INVERSE, len(data))
        space = _SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        starts, ends = edge[0::2], edge[1::2]
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_VALUE[data] * self.powers[: len(data)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))
        text_ends = np.cumsum([len(t) + 1 for t in texts]) + 1
        return hashes, np.diff(np.searchsorted(starts, text_ends), prepend=0)


def shingle_sets(texts: Sequence[str | None], size: int) -> Iterator[np.ndarray]:
    """For every text its set of shingles: distinct hashes in ascending order.

    A shingle is ``size`` consecutive words, A-Z lower-cased. A text with fewer
    words has one shingle, all of its words; one without words has none.
    """
    hasher = WordHasher()
    block: list[bytes] = []
    held = 0
    for text in texts:
        encoded = (text or "").encode("utf-8", "surrogatepass")
        if block and held + len(encoded) > BLOCK_BYTES:
            yield from _block_sets(hasher, block, size)
            block, held = [], 0
        block.append(encoded)
        held += len(encoded)
    if block:
        yield from _block_sets(hasher, block, size)


def _block_sets(hasher: WordHasher, texts: Sequence[bytes], size: int) -> Iterator[np.ndarray]:
    words, counts = hasher.words(texts)
    n = len(words) - size + 1
    joined = np.zeros(max(n, 0), dtype=np.uint64)
    for i in range(size):
        joined = mix(joined * np.uint64(_BASE) + words[i : i + len(joined)] + np.uint64(i + 1))
    start = 0
    for count in counts.tolist():
        if count == 0:
            found = words[:0]
        elif count < size:
            found = np.array([count + (1 << 40)], dtype=np.uint64)
            for i in range(start, start + count):
                found = mix(found * np.uint64(_BASE) + words[i : i + 1])
        else:
            found = np.sort(joined[start : start + count - size + 1])
            if len(found) > 1:
                found = found[np.concatenate([[True], found[1:] != found[:-1]])]
        start += count
        yield found
