"""License scans: text blocks that contain a license's words.

Templates and text blocks are sets of words. A block is any stretch of words of
a text, across lines, that is ``spread`` as long as the template at most. Words
are put into one order by the number of lines of the corpus that hold them, rare
ones first. A block that holds the share ``percent`` of a template must hold one
of the template's first few words; only the blocks around these are compared
with it. Fixed phrases are looked up besides.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import few_rows, ship, UPPER

_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans(UPPER, UPPER.lower())

# Phrases, and statements by which licenses are recognised.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "dedicated to the public domain under CC0"),
    ("all-rights-reserved", "All rights reserved"),
)


@dataclass(frozen=True)
class Scan:
    """A template is found in a block that holds 100 * words >= ``percent`` * the template's words.

    A block has ``spread`` percent of the words of the template at most, all its
    repeated words counted: all blocks of that length are looked at.
    """

    templates: Sequence[tuple[str, str]] = TEMPLATES
    phrases: Sequence[tuple[str, str]] = PHRASES
    percent: int = 90
    spread: int = 200


def scan_licenses(
    docs: DataFrame, scan: Scan = Scan(), id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Rows (id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks).

    One for each of ``docs``; a null text counts as empty. ``n_base`` counts all
    places of the phrases, ``first_word`` and ``last_word`` are the first and
    last of them, null if there is none. ``labels`` are those of the phrases and
    of the templates found; ``score`` is the best containment that reaches the
    threshold (1 for a phrase), else 0. ``blocks`` lists the line of the first
    word, label and containment of each place where a template was found. Repeated rows get equal answers.
    """
    ship(docs.sparkSession)
    texts = docs.select(
        F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text")
    )
    scanner = Scanner(scan, _frequencies(texts, scan))
    names = ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]
    block = pa.struct([("line", pa.int32()), ("label", pa.string()), ("containment", pa.float64())])
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(block)]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            rows = [scanner.scan(text) for text in batch.column("text").to_pylist()]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=names)

    return texts.mapInArrow(
        find,
        "id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
        "labels string, score double, blocks array<struct<line int, label string, containment double>>",
    ).withColumnRenamed("id", id_column)


def _frequencies(texts: DataFrame, scan: Scan) -> dict[str, int]:
    """In how many lines of the corpus each word of a template stands."""
    wanted = frozenset(w for _, text in scan.templates for w in words(text))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in few_rows(batches):
            for text in batch.column("text").to_pylist():
                for line in (text or "").translate(_LOWER).split("\n"):
                    total.update(wanted.intersection(_WORDS.findall(line)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"]
        )

    counted = texts.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in counted.collect()}


def words(text: str) -> list[str]:
    return _WORDS.findall(text.translate(_LOWER))


class Scanner:
    """The templates, indexed by the rare words of each."""

    def __init__(self, scan: Scan, frequencies: dict[str, int]) -> None:
        self.percent = scan.percent
        self.phrases = [(phrase.split(), label) for phrase, label in scan.phrases]
        vocabulary = {w for _, text in scan.templates for w in words(text)}
        order = sorted(vocabulary, key=lambda w: (frequencies.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(order)}
        self.templates = []
        self.index: dict[int, list[int]] = {}
        for label, text in scan.templates:
            ranks = sorted({self.rank[w] for w in words(text)})
            if not ranks:
                continue
            least = -(-scan.percent * len(ranks) // 100)
            for rank in ranks[: len(ranks) - least + 1]:
                self.index.setdefault(rank, []).append(len(self.templates))
            self.templates.append((label, frozenset(ranks), least, max(scan.spread * len(words(text)) // 100, len(ranks))))
        self.rare = frozenset(w for w, r in self.rank.items() if r in self.index)

    def scan(self, text: str | None):
        lower = (text or "").translate(_LOWER)
        all_words = _WORDS.findall(lower)
        n_words, found = len(all_words), []
        if not self.rare.isdisjoint(all_words):
            found = self._matches(all_words, lower)
        places: list[int] = []
        base = set()
        for phrase, label in self.phrases:
            if starts := _places(all_words, phrase):
                places += starts
                base.add(label)
        labels = base | {f["label"] for f in found}
        score = max([1.0 if base else 0.0, *(f["containment"] for f in found)])
        first, last = (min(places), max(places)) if places else (None, None)
        return n_words, len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, found

    def _matches(self, held: list[str], lower: str) -> list[dict]:
        """Line, label and containment of each place where a template is found."""
        hits = [(at, self.rank[w]) for at, w in enumerate(held) if w in self.rank]
        # Stretches of the text around the rare words of each template.
        near: dict[int, list[list[int]]] = {}
        for at, rank in hits:
            for template in self.index.get(rank, ()):
                reach = self.templates[template][3] - 1
                stretches = near.setdefault(template, [])
                if stretches and at - reach <= stretches[-1][1]:
                    stretches[-1][1] = at + reach
                else:
                    stretches.append([at - reach, at + reach])
        places = [
            (at, self.templates[template][0], common / len(self.templates[template][1]))
            for template, stretches in near.items()
            for start, end in stretches
            for at, common in self._runs(hits[bisect_left(hits, (start,)) : bisect_right(hits, (end + 1,))], template)
        ]
        if not places:
            return []
        ends, total = [], 0
        for line in lower.split("\n"):
            ends.append(total := total + len(_WORDS.findall(line)))
        return [{"line": bisect_right(ends, at), "label": label, "containment": c} for at, label, c in sorted(places)]

    def _runs(self, hits: list[tuple[int, int]], template: int) -> Iterator[tuple[int, int]]:
        """First word and number of common words of the best of all blocks that follow each other and hold enough."""
        _, ranks, least, length = self.templates[template]
        hits = [h for h in hits if h[1] in ranks]
        block: Counter[int] = Counter()
        first, common, best = 0, 0, (0, 0)
        for at, rank in hits:
            # Words that have left the block; a run ends where too few are left.
            while at - hits[first][0] >= length:
                block[hits[first][1]] -= 1
                common -= not block[hits[first][1]]
                first += 1
            if common < least and best[1]:
                yield best
                best = (0, 0)
            block[rank] += 1
            common += block[rank] == 1
            while block[hits[first][1]] > 1:
                block[hits[first][1]] -= 1
                first += 1
            if common >= least and common > best[1]:
                best = (hits[first][0], common)
        if best[1]:
            yield best


def _places(held: list[str], phrase: list[str]) -> list[int]:
    starts, at = [], -1
    rare, last = phrase[0], len(phrase)
    while True:
        try:
            at = held.index(rare, at + 1)
        except ValueError:
            return starts
        if held[at : at + last] == phrase:
            starts.append(at)
