"""The plan of a packing, worked out on counts of lengths.

Input is how many pieces there are of each length (at most ``capacity``
numbers), so this is the same small work for any corpus. Output says which
ranks of each length go to which sequences, at which offset.

The linear grouping scheme: long pieces, in descending order, are cut into
groups of equal number and rounded up to the longest of their group. For these
sizes, of which there are fewer than places in a sequence whatever the corpus, a
linear programme over patterns (what one sequence holds) is solved by column
generation. Each pattern is used as often as the solution says, rounded down;
the actual lengths take the places of the rounded ones, but for the last place
of a pattern, which goes to what then fits best. So do all other pieces.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np


@dataclass
class Plan:
    """Placements (length, first rank, count, first sequence, offset) of consecutive ranks."""

    placements: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0


def plan_packing(counts: dict[int, int], capacity: int, groups: int = 400) -> Plan:
    """The plan for pieces counted by length, none longer than ``capacity``.

    Rounding up wastes more than it saves where lengths are spread evenly over
    more sizes than there are groups; then the pieces are placed by best fit alone.
    """
    packer, alone = _Packer(counts, capacity), _Packer(counts, capacity)
    # Longer than a quarter, so that three fit into a sequence at most; whole sequences need no plan.
    long_ = [(length, n) for length, n in sorted(counts.items(), reverse=True) if capacity < 4 * length < 4 * capacity]
    sizes, members = _groups(long_, groups)
    for pattern, times in _patterns(sizes, [sum(n for _, n in m) for m in members], capacity):
        packer.fill(pattern, times, members)
    packer.best_fit()
    alone.best_fit()
    return packer.plan if packer.plan.sequences <= alone.plan.sequences else alone.plan


def _groups(long_: list[tuple[int, int]], groups: int):
    """Rounded sizes and, for each, its actual [length, number] in descending order.

    With no more lengths than groups each is one, and nothing is rounded.
    """
    if len(long_) <= groups:
        return [length for length, _ in long_], [[[length, n]] for length, n in long_]
    total = sum(n for _, n in long_)
    sizes: list[int] = []
    members: list[list[list[int]]] = []
    room = 0
    each = -(-total // groups) if total else 0
    for length, n in long_:
        while n:
            if not room:
                room = each
                if not sizes or sizes[-1] != length:
                    sizes.append(length)
                    members.append([])
            take = min(n, room)
            members[-1].append([length, take])
            n, room = n - take, room - take
    return sizes, members


def _patterns(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """How often each pattern is used: {place of the size: pieces}, times.

    Patterns enter as long as they could save half a sequence.
    """
    k = len(sizes)
    if not k:
        return []
    size, wanted = np.array(sizes), np.array(demand, dtype=float)
    basis = np.diag([float(capacity // s) for s in sizes])
    inverse = np.diag(1 / np.diag(basis))
    used = inverse @ wanted
    for turn in range(1, 40 * k):
        prices = inverse.sum(axis=0)
        column = _best_pattern(size, prices, capacity)
        value, total = prices @ column, used.sum()
        if total - total / max(value, 1.0) < 0.5:
            break
        change = inverse @ column
        ratios = np.where(change > 1e-9, used / np.where(change > 1e-9, change, 1), np.inf)
        out = int(np.argmin(ratios))
        basis[:, out] = column
        if turn % 500:
            row = inverse[out] / change[out]
            inverse -= np.outer(change, row)
            inverse[out] = row
            used = np.maximum(used - ratios[out] * change, 0)
            used[out] = ratios[out]
        else:  # what rounding has added up goes
            inverse = np.linalg.inv(basis)
            used = np.maximum(inverse @ wanted, 0)
    found = []
    for i in range(k):
        times = int(used[i] + 1e-6)
        if times:
            found.append(({j: int(round(basis[j, i])) for j in np.flatnonzero(basis[:, i] > 0.5).tolist()}, times))
    return found


def _best_pattern(size: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """The most valuable pieces, three at most, that fit into one sequence."""
    k = len(size)
    # The best single piece for every room; place k stands for none.
    worth = np.append(prices, 0.0)
    best = np.full(capacity + 1, k)
    at = k
    by_size = np.argsort(size, kind="stable")
    sorted_sizes = size[by_size]
    for i in range(k):
        if worth[by_size[i]] > worth[at]:
            at = by_size[i]
        best[sorted_sizes[i] : sorted_sizes[i + 1] if i + 1 < k else None] = at
    room = capacity - np.append(size, 0)
    rest = room[:, None] - np.append(size, 0)[None, :]
    third = np.where(rest >= 0, best[np.maximum(rest, 0)], k)
    value = np.where(rest >= 0, worth[:, None] + worth[None, :] + worth[third], -1.0)
    first, second = np.unravel_index(int(np.argmax(value)), value.shape)
    column = np.zeros(k + 1)
    for place in (first, second, third[first, second]):
        column[place] += 1
    return column[:k]


class _Packer:
    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.left = {length: n for length, n in counts.items() if n}
        self.next_rank: dict[int, int] = defaultdict(int)
        self.capacity = capacity
        self.plan = Plan()
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by room left: (first, number)
        self.rooms: list[int] = []  # those with runs, ascending

    def fill(self, pattern: dict[int, int], times: int, members: list[list[list[int]]]) -> None:
        """Use a pattern ``times`` times, as far as there are pieces for it.

        The place of its shortest piece is left to ``best_fit``, which knows how
        much room the actual lengths leave.
        """
        places = [size for size, pieces in sorted(pattern.items()) for _ in range(pieces)][:-1]
        if not places or not times:
            return
        first = self.plan.sequences
        self.plan.sequences += times
        runs = [(first, times, 0)]
        for size in places:
            runs = self._slot(runs, members[size])
        for start, n, used in runs:
            self._leave(start, n, self.capacity - used)

    def _slot(self, runs, members):
        out = []
        for start, n, used in runs:
            while n and members:
                length, there = members[0]
                take = min(n, there)
                self._place(length, take, start, used)
                out.append((start, take, used + length))
                start, n = start + take, n - take
                if take == there:
                    members.pop(0)
                else:
                    members[0][1] -= take
            if n:
                out.append((start, n, used))
        return out

    def best_fit(self) -> None:
        for length in sorted(self.left, reverse=True):
            while n := self.left[length]:
                at = bisect_left(self.rooms, length)
                if at == len(self.rooms):
                    self._open(length, n)
                    break
                room = self.rooms[at]
                start, there = self.runs[room].pop()
                if not self.runs[room]:
                    self.rooms.pop(at)
                take = min(n, there)
                self._place(length, take, start, self.capacity - room)
                if take < there:
                    self._leave(start + take, there - take, room)
                self._leave(start, take, room - length)

    def _open(self, length: int, n: int) -> None:
        each = self.capacity // length
        for number, pieces in ((n // each, each), (1, n % each)):
            if number and pieces:
                first = self.plan.sequences
                self.plan.sequences += number
                for i in range(pieces):
                    self._place(length, number, first, i * length)
                self._leave(first, number, self.capacity - pieces * length)

    def _place(self, length: int, n: int, sequence: int, offset: int) -> None:
        self.plan.placements.append((length, self.next_rank[length], n, sequence, offset))
        self.next_rank[length] += n
        self.left[length] -= n

    def _leave(self, start: int, n: int, room: int) -> None:
        if room and n:
            if not self.runs[room]:
                insort(self.rooms, room)
            self.runs[room].append((start, n))
