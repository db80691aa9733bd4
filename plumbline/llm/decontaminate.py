"""Benchmark decontamination: words of documents that repeat a benchmark's word windows.

Benchmark items are cut into windows of consecutive words. Their words are
numbered and their windows hashed; numbers, hashes and the items of each window
are broadcast in blocks of bounded size. Tasks number the words of their
documents alike, hash every window and look it up. A hit counts only if all the
window's words agree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.common import ascii_lower, few_rows, fresh, materialize, ship
from plumbline.llm.shingles import mix

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same words in lower-cased UTF-8: ASCII letters and digits, and all bytes of other characters.
_WORDS = re.compile(rb"[a-z0-9\x80-\xff]+")
_GAP = re.compile(rb"[^a-z0-9\x80-\xff]")
_CHUNK = 1 << 20  # bytes of a text that are split into words at a time
_STEP = 512  # windows of an item that are kept together
HITS = "struct<n_words: bigint, spans: array<struct<first: bigint, stop: bigint>>, items: array<string>>"
_SPAN = pa.struct([("first", pa.int64()), ("stop", pa.int64())])


@dataclass(frozen=True)
class Windows:
    """``words`` consecutive words; an item of fewer, but not none, is one window.

    ``block_words`` bounds what is broadcast at a time: a larger benchmark is
    dealt into several blocks by a hash, and the documents are read once for each.
    """

    words: int = 10
    block_words: int = 1 << 22


def contamination(
    docs: DataFrame,
    items: DataFrame,
    windows: Windows = Windows(),
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """Rows (id, n_words, n_hit, n_items, items_sha256, contaminated), one for every row of ``docs``.

    A word is hit if it lies inside any occurrence of a window of ``items``.
    ``n_items`` counts the items with windows that occur; ``items_sha256`` is the
    digest of their ids, sorted as strings and joined by commas (of the empty
    string where there are none). Null and wordless texts have no words and are
    hit nowhere; wordless items have no window. An item without an id hits words
    but is neither counted nor named. Repeated rows get equal answers, items that
    share an id are one item. Texts of any length are read as a whole, in chunks.
    With an empty table of items nothing is hit. Other columns are ignored.
    """
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    found = find_windows(texts, items, windows, "text", item_column, item_text_column)
    hits = found.columns[-1]
    n_hit = F.aggregate(f"{hits}.spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["first"])
    return found.select(
        F.col("id").alias(id_column),
        F.col(f"{hits}.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(f"{hits}.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(f"{hits}.items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    windows: Windows = Windows(),
    remove: str = "spans",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """The columns of ``docs`` without what repeats the windows of ``items``.

    ``remove="spans"`` cuts out of the texts every run of hit words, from the
    first character of its first word to the last of its last; all rows stay, and
    texts without a hit stay as they are. ``remove="documents"`` drops every row
    with a hit. Null texts stay null. See ``contamination`` for the rest.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove is 'spans' or 'documents'")
    found = find_windows(docs, items, windows, text_column, item_column, item_text_column)
    hits = found.columns[-1]
    if remove == "documents":
        return found.where(F.size(f"{hits}.spans") == 0).drop(hits)
    schema = docs.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            place = batch.schema.names.index(text_column)
            spans = [h["spans"] for h in batch.column(hits).to_pylist()]
            texts = [_without(t, s) if s else t for t, s in zip(batch.column(place).to_pylist(), spans)]
            columns = batch.columns[:-1]
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return found.mapInArrow(cut, schema)


def find_windows(
    docs: DataFrame, items: DataFrame, windows: Windows, text_column: str, item_column: str, item_text_column: str
) -> DataFrame:
    """``docs`` and, as the last column, the hits of each text: its words, hit runs of them, and items."""
    ship(docs.sparkSession)
    name = fresh(docs, "hits")
    # The benchmark by segments of windows; copies of a segment are one.
    segments = materialize(_segments(items, windows, item_column, item_text_column))
    total = segments.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = -(-total // windows.block_words) or 1
    if blocks == 1:
        return _scan(docs, _Lookup(segments.collect(), windows.words), text_column, name)
    # One pass for each block; equal texts have equal hits, which are found by a digest.
    key = fresh(docs, "digest")
    digest = F.sha2(F.col(text_column).cast("binary"), 256)
    texts = docs.where(F.col(text_column).isNotNull()).select(digest.alias("digest"), F.col(text_column).alias("text"))
    parts = []
    for block in range(blocks):
        rows = segments.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == block).collect()
        scanned = _scan(texts, _Lookup(rows, windows.words), "text", "hits").where("size(hits.spans) > 0")
        parts.append(materialize(scanned.groupBy("digest").agg(F.first("hits").alias("hits"))))
    hit = reduce(DataFrame.unionByName, parts).groupBy("digest").agg(F.collect_list("hits").alias("each"))
    n_words = F.regexp_count(ascii_lower(F.coalesce(F.col(text_column), F.lit(""))), F.lit(WORDS)).cast("bigint")
    whole = F.struct(
        n_words.alias("n_words"),
        F.coalesce(_merged(F.flatten("each.spans")), F.array().cast("array<struct<first: bigint, stop: bigint>>")).alias("spans"),
        F.coalesce(F.array_sort(F.array_distinct(F.flatten("each.items"))), F.array().cast("array<string>")).alias("items"),
    )
    # A row without a text meets nothing; it goes by a key of its own, not to one task with the others.
    alone = F.monotonically_increasing_id().cast("string")
    keyed = docs.withColumn(key, F.coalesce(digest, alone))
    return keyed.join(hit.withColumnRenamed("digest", key), key, "left").select(*docs.columns, whole.alias(name))


def _merged(spans: Column) -> Column:
    """Runs of words that overlap or touch as one."""
    none = F.array().cast("array<struct<first: bigint, stop: bigint>>")

    def add(runs: Column, span: Column) -> Column:
        last = F.element_at(runs, -1)
        longer = F.struct(last["first"].alias("first"), F.greatest(last["stop"], span["stop"]).alias("stop"))
        meets = (F.size(runs) > 0) & (F.when(F.size(runs) > 0, last["stop"]) >= span["first"])
        return F.when(meets, F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(longer))).otherwise(
            F.concat(runs, F.array(span))
        )

    return F.aggregate(F.array_sort(spans), none, add)


def _segments(items: DataFrame, windows: Windows, item_column: str, text_column: str) -> DataFrame:
    """Rows (words, items): stretches of words whose windows cover all items, each once."""
    held = items.select(
        F.col(item_column).cast("string").alias("item"),
        F.regexp_extract_all(ascii_lower(F.col(text_column).cast("string")), F.lit(WORDS), F.lit(0)).alias("all"),
    ).where("size(all) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - windows.words, F.lit(0)), F.lit(_STEP))
    cut = held.select("item", "all", F.explode(starts).alias("start"))
    return (
        cut.select("item", F.slice("all", F.col("start") + 1, F.lit(_STEP + windows.words - 1)).alias("words"))
        .groupBy("words")
        .agg(F.collect_set("item").alias("items"))
    )


class _Lookup:
    """The windows of a block of segments: word numbers, hashes, and the segments that hold each."""

    def __init__(self, segments: Sequence[tuple[list[str], list[str]]], size: int) -> None:
        self.numbers: dict[bytes, int] = {}
        self.items = [held for _, held in segments]
        by_size: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        for segment, (words, _) in enumerate(segments):
            ids = np.array([self.numbers.setdefault(w.encode(), len(self.numbers)) for w in words], dtype=np.int32)
            length = min(size, len(ids))
            rows, owners = by_size.setdefault(length, ([], []))
            found = np.lib.stride_tricks.sliding_window_view(ids, length)
            rows.append(found)
            owners.append(np.full(len(found), segment))
        self.tables = []
        for length, (rows, owners) in sorted(by_size.items()):
            distinct, place = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
            hashes = _hashes(distinct.ravel(), length, np.arange(len(distinct)) * length)
            order = np.argsort(hashes, kind="stable")
            back = np.empty(len(order), dtype=np.int64)
            back[order] = np.arange(len(order))
            pairs = np.unique(np.column_stack([back[place.ravel()], np.concatenate(owners)]), axis=0)
            first = np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))
            self.tables.append((length, hashes[order], distinct[order], first, pairs[:, 1]))

    def word_ids(self, text: bytes) -> np.ndarray:
        """The number of every word of a text, -1 for words of no window."""
        text, at, parts = text.lower(), 0, []
        while at < len(text):
            gap = _GAP.search(text, at + _CHUNK)
            end = gap.start() if gap else len(text)
            found = _WORDS.findall(text, at, end)
            parts.append(np.fromiter(map(self.numbers.get, found, repeat(-1)), dtype=np.int32, count=len(found)))
            at = end
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def occurrences(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each length: starts of occurring windows, and pairs (start, segment) of them."""
        unknown = np.concatenate([[0], np.cumsum(ids < 0)])
        for length, hashes, rows, first, owners in self.tables:
            if len(ids) < length:
                continue
            starts = np.flatnonzero(unknown[length:] == unknown[:-length])
            wanted = _hashes(ids, length, starts)
            low, high = np.searchsorted(hashes, wanted), np.searchsorted(hashes, wanted, side="right")
            met = np.flatnonzero(high > low)
            starts, low, high = starts[met], low[met], high[met]
            for more in range(int((high - low).max(initial=0))):  # over one only if hashes collide
                some = low + more < high
                at, row = starts[some], low[some] + more
                same = (ids[at[:, None] + np.arange(length)] == rows[row]).all(axis=1)
                at, row = at[same], row[same]
                if len(at):
                    held = first[row + 1] - first[row]
                    ends = np.cumsum(held)
                    each = np.arange(ends[-1]) - np.repeat(ends - held, held) + np.repeat(first[row], held)
                    yield length, at, np.repeat(at, held), owners[each]


def _hashes(ids: np.ndarray, length: int, starts: np.ndarray) -> np.ndarray:
    """A hash of the ``length`` numbers from each start on."""
    spread = mix(ids.astype(np.uint64) + np.uint64(1))
    total = np.zeros(len(starts), dtype=np.uint64)
    for k in range(length):
        total = total * np.uint64(0x9E3779B97F4A7C15) + spread[starts + k]
    return mix(total)


def _scan(docs: DataFrame, lookup: _Lookup, text_column: str, name: str) -> DataFrame:
    """``docs`` and a column of hits."""
    shared = docs.sparkSession.sparkContext.broadcast(lookup)
    schema = docs.select("*", F.lit(None).cast(HITS).alias(name)).schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in few_rows(batches):
            texts = batch.column(batch.schema.names.index(text_column)).cast(pa.binary()).to_pylist()
            found = _hits([known.word_ids(t or b"") for t in texts], known)
            column = pa.array(found, pa.struct([("n_words", pa.int64()), ("spans", pa.list_(_SPAN)), ("items", pa.list_(pa.string()))]))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])

    return docs.mapInArrow(scan, schema)


def _hits(texts: list[np.ndarray], lookup: _Lookup) -> list[dict]:
    """Words, hit runs and items of some texts, looked up together."""
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    # A word of no window between the texts, so that no window reaches across.
    ids = np.concatenate([x for t in texts for x in (t, np.full(1, -1, np.int32))]) if texts else np.zeros(0, np.int32)
    edges = np.zeros(len(ids) + 1, dtype=np.int64)
    items: dict[int, set[str]] = {}
    for length, at, starts, owners in lookup.occurrences(ids):
        np.add.at(edges, at, 1)
        np.add.at(edges, at + length, -1)
        owned = np.column_stack([np.searchsorted(begins, starts, side="right") - 1, owners])
        for doc, segment in np.unique(owned, axis=0).tolist():
            items.setdefault(doc, set()).update(lookup.items[segment])
    hit = np.concatenate([[False], np.cumsum(edges)[:-1] > 0, [False]])
    change = np.flatnonzero(hit[1:] != hit[:-1])
    first, stop = change[0::2], change[1::2]
    owner = np.searchsorted(begins, first, side="right") - 1
    found = [
        {"n_words": len(t), "spans": [], "items": sorted(items.get(doc, ()))}
        for doc, t in enumerate(texts)
    ]
    for doc, a, b in zip(owner.tolist(), first.tolist(), stop.tolist()):
        found[doc]["spans"].append({"first": a - int(begins[doc]), "stop": b - int(begins[doc])})
    return found


def _without(text: str, spans: list[dict]) -> str:
    """The text without the characters of some runs of words."""
    raw = text.encode()
    places = [(m.start(), m.end()) for m in _WORDS.finditer(raw.lower())]
    kept, at = [], 0
    for span in spans:
        kept.append(raw[at : places[span["first"]][0]])
        at = places[span["stop"] - 1][1]
    return b"".join([*kept, raw[at:]]).decode()
