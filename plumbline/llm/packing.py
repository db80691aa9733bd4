"""Best-fit packing of documents into token sequences by linear grouping."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from plumbline.llm.common import few_rows, materialize_from_texts, ship
from plumbline.llm.packing_plan import plan_packing

ROWS_PER_TASK = 500_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


@dataclass(frozen=True)
class Packing:
    """Sequences of ``capacity`` tokens; every document ends with ``end_id``.

    ``tokenizer`` is the path of a file of the tokenizers library on every
    executor; without one it is the public byte-level vocabulary of 50k entries.
    """

    capacity: int = 1024
    end_id: int = 2
    tokenizer: str | None = None
    groups: int = 400


def pack_documents(
    docs: DataFrame, packing: Packing = Packing(), id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one per piece.

    A document is its token ids and the end id; a null or empty text is the end
    id alone. Documents longer than a sequence are cut into whole sequences
    behind a shorter first piece. ``start`` is the number of the document's ids
    before the piece. The pieces of a sequence lie in it without gap from 0.
    Each row of ``docs`` is packed, rows that repeat as well; which of the equal
    ones goes where is open. Other columns are ignored.
    """
    ship(docs.sparkSession)
    texts = docs.select(
        F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).cast("string").alias("text")
    )
    pieces = materialize_from_texts(texts.mapInArrow(_pieces(packing), PIECES))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = plan_packing(counts, packing.capacity, packing.groups)
    placed = _ranked(pieces, sum(counts.values())).mapInArrow(
        _placed(plan), f"{PIECES}, sequence_id bigint, offset bigint"
    )
    return placed.withColumnRenamed("doc_id", id_column)


def _ranked(pieces: DataFrame, rows: int) -> DataFrame:
    """The pieces with their rank among those of the same length.

    Pieces of one length are dealt to as many parts as there are tasks' worth of
    rows, ranked within, and shifted by the number in the parts before.
    """
    parts = max(1, -(-rows // ROWS_PER_TASK)) * 4
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    sizes = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(inside) - 1)
    return ranked.join(shifts, ["length", "part"]).select(
        *pieces.columns, (F.col("rank") + F.col("shift")).alias("rank")
    )


def _placed(plan):
    """Look the ranks up in the plan, for mapInArrow."""
    table = np.array(sorted(plan.placements), dtype=np.int64).reshape(-1, 5)
    # Length and rank in one ascending number.
    keys = (table[:, 0] << 48) | table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            length = batch.column("length").to_numpy(zero_copy_only=False)
            found = table[np.searchsorted(keys, (length << 48) | rank, side="right") - 1]
            sequence = found[:, 3] + rank - found[:, 1]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(sequence), pa.array(found[:, 4])],
                names=[*names, "sequence_id", "offset"],
            )

    return place


def _pieces(packing: Packing):
    """Tokenise and cut, for mapInArrow."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from plumbline.llm.tokens import encoder

        encode = encoder(packing.tokenizer)
        end = np.array([packing.end_id], dtype="<u4").tobytes()
        capacity = packing.capacity
        for batch in few_rows(batches):
            docs, places, starts, lengths, sums = [], [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encode(text or "") + end
                n = len(ids) // 4
                first = n % capacity or capacity
                cuts = [0, *range(first, n + 1, capacity)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    docs.append(doc)
                    places.append(i)
                    starts.append(a)
                    lengths.append(b - a)
                    sums.append(zlib.crc32(ids[4 * a : 4 * b]))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = (docs, places, starts, lengths, sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return cut
