"""Line dedup by content-defined chunks and by passages of lines.

A rolling hash over the hashes of neighbouring lines chooses where a chunk
ends, so a passage is cut alike wherever it stands, some lines after its start.
A line as long as a passage is a chunk of its own. Chunks of several lines, and
such passages, that occur again in the corpus are removed but for their first
occurrence, once their bytes have been compared.

Passages of several lines do not depend on where a chunk ends. From each line on
the fewest lines that make up a passage are one window, and up to each line the
fewest such lines are another. A run of lines with the words of a passage that
stands elsewhere too consists of such windows, whatever its neighbours.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import (
    FILTER_BITS,
    few_rows,
    fresh,
    hash_bits,
    materialize,
    materialize_from_texts,
    maybe_in,
    ship,
)

_UNITS = "id bigint, line int, n int, h1 bigint, h2 bigint, text string"


@dataclass(frozen=True)
class Chunks:
    """A chunk ends after a line where the hash of the last ``window`` lines is divisible by ``divisor``.

    It has ``least`` lines at least, where the text or a passage does not end
    it, and ``most`` at most. ``words`` is the least number of words of a chunk
    of several lines worth removing; a line of ``passage`` words or more stands
    alone and is removed like one.
    """

    window: int = 2
    divisor: int = 2
    least: int = 2
    most: int = 16
    words: int = 8
    passage: int = 50

    def long(self, line: str) -> bool:
        return len(line) >= 2 * self.passage - 1 and len(line.split()) >= self.passage


def dedup_lines(
    docs: DataFrame,
    chunks: Chunks = Chunks(),
    id_column: str = "doc_id",
    text_column: str = "text",
    passages: bool = False,
) -> DataFrame:
    """The rows of ``docs`` with repeated chunks cut out of the text.

    With ``passages`` also every run of lines, of ``chunks.passage`` words or
    more, that stands elsewhere too; blank lines around it stay. A line counts
    as a whole: what is alike within two different lines stays.

    All columns stay; ``n_lines``, ``n_removed_lines`` and ``n_removed_chunks``,
    the chunks that went with all their lines, are added (with underscores added
    to the name if there is such a column). Lines are separated by \\n and keep
    every other character. The first occurrence is the one of the smallest
    (id, line); an occurrence that overlaps it in the same text loses only the
    lines after it. Each line that goes stands in an earlier place that stays. A
    text that consists of repeated chunks alone becomes empty; a null text stays
    null, with 0 lines. Copies of a document lose their chunks of several lines.
    Rows that repeat an id and text are one document and keep the same lines.
    Documents without an id count as occurrences but stay as they are. Two
    different chunks under one 128-bit key would both be left alone.
    """
    ship(docs.sparkSession)
    texts = docs.select(
        F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text")
    )
    keys = texts.mapInArrow(_key_rows(chunks, passages), "h1 bigint")
    suspects = materialize_from_texts(keys.groupBy("h1").agg(F.count("*").alias("times")).where("times > 1").select("h1"))
    found = materialize_from_texts(texts.mapInArrow(_unit_rows(chunks, passages, hash_bits(suspects)), _UNITS))
    removed = (
        found.where("id IS NOT NULL")
        .select("id", "line", "n", "h1", "h2")
        .join(_compared(found), ["h1", "h2"])
        .where("first_id IS NULL OR id != first_id OR line != first_line")
        .withColumn("start", F.expr("if(id <=> first_id, greatest(line, first_line + n), line)"))
        .groupBy("id")
        .agg(F.sort_array(F.collect_set(F.struct("line", "n", "h1", "h2", "start"))).alias("cuts"))
    )
    return _without(docs, materialize(removed), chunks, id_column, text_column)


def _compared(found: DataFrame) -> DataFrame:
    """Rows (h1, h2, first_id, first_line) of keys with one text only, found more than once.

    Grouped by their bytes; equal ones are counted before they are shuffled.
    """
    alike = found.groupBy("h1", "h2", "text").agg(
        F.min(F.struct("id", "line")).alias("first"), F.count("*").alias("times")
    )
    return materialize(
        alike.groupBy("h1", "h2")
        .agg(F.count("*").alias("texts"), F.sum("times").alias("times"), F.min("first").alias("first"))
        .where("texts = 1 AND times > 1")
        .select("h1", "h2", F.col("first.id").alias("first_id"), F.col("first.line").alias("first_line"))
    )


def _without(
    docs: DataFrame, removed: DataFrame, chunks: Chunks, id_column: str, text_column: str
) -> DataFrame:
    names = [fresh(docs, n) for n in ("n_lines", "n_removed_lines", "n_removed_chunks")]
    cuts, key = fresh(docs, "cuts"), fresh(docs, "cut_id")
    removed = removed.select(F.col("id").alias(key), F.col("cuts").alias(cuts))
    lines = F.when(F.col(text_column).isNull(), 0).otherwise(F.size(F.split(F.col(text_column), "\n"))).cast("bigint")
    zero = F.lit(0).cast("bigint")

    def cut(texts, lists):
        import pandas as pd

        out = []
        for text, found in zip(texts, lists):
            lines = text.split("\n")
            stays = np.ones(len(lines), dtype=bool)
            for c in found:
                end = c["line"] + c["n"]
                if end <= len(lines) and _keys("\n".join(lines[c["line"] : end]).encode("utf-8", "surrogatepass")) == (c["h1"], c["h2"]):
                    stays[c["start"] : end] = False
            many = sum(not stays[start : start + n].any() for start, n in _chunks(text, chunks))
            kept = [line for line, stay in zip(lines, stays) if stay]
            out.append(("\n".join(kept), len(lines) - len(kept), many))
        return pd.DataFrame(out, columns=["text", "lines", "chunks"])

    # Else a filter on the result would be pushed below it and every text cut twice, by two workers a task.
    cut = F.pandas_udf(cut, "text string, lines bigint, chunks bigint", F.PandasUDFType.SCALAR).asNondeterministic()

    # Texts without repeats never leave their place; only the others meet their cuts.
    maybe = maybe_in(removed.select(F.xxhash64(key)))
    hit = maybe(F.xxhash64(F.col(id_column).cast("bigint")))
    same = docs.where(~hit).select("*", lines.alias(names[0]), zero.alias(names[1]), zero.alias(names[2]))
    met = docs.where(hit).join(removed, F.col(id_column).cast("bigint") == F.col(key), "left")
    untouched = met.where(F.col(cuts).isNull() | F.col(text_column).isNull())
    untouched = untouched.select(*[F.col(f"`{c}`") for c in docs.columns], lines.alias(names[0]), zero.alias(names[1]), zero.alias(names[2]))
    result = fresh(docs, "result")
    changed = met.where(F.col(cuts).isNotNull() & F.col(text_column).isNotNull())
    changed = changed.withColumn(result, cut(F.col(text_column), F.col(cuts))).select(
        *[F.col(f"{result}.text").alias(c) if c == text_column else F.col(f"`{c}`") for c in docs.columns],
        lines.alias(names[0]),
        F.col(f"{result}.lines").alias(names[1]),
        F.col(f"{result}.chunks").alias(names[2]),
    )
    return same.unionByName(untouched).unionByName(changed)


def _key_rows(chunks: Chunks, passages: bool):
    """One half of the key of each chunk worth removing, and of the window from each line on, for mapInArrow."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            first = []
            for text in batch.column("text").to_pylist():
                if text is not None:
                    data, at, counts = _lines(text)
                    units = _worth(text, counts, chunks) | (_windows(counts, chunks.passage) if passages else set())
                    first += [_keys(data[at[line] : at[line + n] - 1])[0] for line, n in units]
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64())], names=["h1"])

    return keys


def _unit_rows(chunks: Chunks, passages: bool, table: np.ndarray):
    """The chunks and windows of each text that may be repeated, for mapInArrow.

    A window up to a line may be only where the one from its first line on may.
    """
    bits = table.astype("<i8").tobytes()

    def maybe(h1: int) -> int:
        place = h1 & (FILTER_BITS - 1)
        return bits[place >> 3] >> (place & 7) & 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches, 64):
            rows = []
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                if text is None:
                    continue
                data, at, counts = _lines(text)
                windows = _windows(counts, chunks.passage) if passages else set()
                held, starts = {}, set()
                for line, n in sorted(_worth(text, counts, chunks) | windows):
                    key = _keys(data[at[line] : at[line + n] - 1])
                    if maybe(key[0]):
                        held[line, n] = key
                        if (line, n) in windows:
                            starts.add(line)
                if starts:
                    for line, n in _windows(counts[::-1], chunks.passage):
                        line = len(counts) - line - n
                        if line in starts and (line, n) not in held:
                            held[line, n] = _keys(data[at[line] : at[line + n] - 1])
                rows += [
                    (doc, line, n, *key, data[at[line] : at[line + n] - 1].decode("utf-8", "surrogatepass"))
                    for (line, n), key in held.items()
                ]
            names = ["id", "line", "n", "h1", "h2", "text"]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return cut


def _lines(text: str) -> tuple[bytes, list[int], list[int]]:
    """A text's bytes, where each line starts in them (and one more would), and the words of each line."""
    data = text.encode("utf-8", "surrogatepass")
    at = [0]
    for line in data.split(b"\n"):
        at.append(at[-1] + len(line) + 1)
    return data, at, [len(line.split()) for line in text.split("\n")]


def _windows(counts: list[int], passage: int) -> set[tuple[int, int]]:
    """First line and number of the fewest lines with ``passage`` words from each line on that is not blank."""
    found, end, total = set(), 0, 0
    for line, n in enumerate(counts):
        while total < passage and end < len(counts):
            total += counts[end]
            end += 1
        if total < passage:
            break
        if n:
            found.add((line, end - line))
        total -= n
    return found


def _chunks(text: str, chunks: Chunks) -> Iterator[tuple[int, int]]:
    """First line and number of lines of each chunk."""
    line = 0
    for lines in _split(text, chunks):
        yield line, len(lines)
        line += len(lines)


def _worth(text: str, counts: list[int], chunks: Chunks) -> set[tuple[int, int]]:
    """The chunks that are worth removing if repeated."""
    return {
        (line, n)
        for line, n in _chunks(text, chunks)
        if sum(counts[line : line + n]) >= (chunks.words if n > 1 else chunks.passage)
    }


def _split(text: str | None, chunks: Chunks) -> Iterator[list[str]]:
    """A text's lines by chunks."""
    import xxhash

    if text is None:
        return
    held: list[str] = []
    last = [0] * chunks.window
    lines = text.split("\n")
    for line in lines:
        alone = chunks.long(line)
        if alone and held:
            yield held
            held = []
        held.append(line)
        last = [*last[1:], xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))]
        rolled = 0
        for h in last:
            rolled = (rolled * 0x9E3779B97F4A7C15 + h) & 0xFFFFFFFFFFFFFFFF
        ends = len(held) >= chunks.least and (rolled >> 20) % chunks.divisor == 0
        if alone or ends or len(held) >= chunks.most:
            yield held
            held = []
    if held:
        yield held


def _keys(data: bytes) -> tuple[int, int]:
    """The two halves of a chunk's 128-bit digest, as signed numbers."""
    import xxhash

    return struct.unpack("<qq", xxhash.xxh3_128_digest(data))
