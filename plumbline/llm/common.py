"""What several operators need: words, shared tables, identifiers."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# White space between words, everywhere in this package.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
GAP_CHARACTERS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    """The words of a text in order; none if it is null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    return F.translate(text, UPPER, UPPER.lower())


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once for a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def read_documents(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it. Only a local session, whose executors
    are its driver, may go without and gets a temporary folder, one for an application.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not (spark.conf.get("spark.master", "") or "").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _folders:
        _folders[application] = tempfile.mkdtemp(prefix="plumbline-")
    return _folders[application]


def few_rows(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: a worker holds so many decoded texts at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, once for an application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root, name = os.path.split(package)
    folder = tempfile.mkdtemp(prefix="plumbline-")
    context.addPyFile(shutil.make_archive(f"{folder}/{name}", "zip", root, name))
    _shipped.add(context.applicationId)


_written: list[str] = []  # tables of this session in the shared folder, as they were made


def written() -> int:
    """How many tables this session has written so far and not discarded."""
    return len(_written)


def discard(spark: SparkSession, first: int, last: int) -> None:
    """Delete the tables number ``first`` up to but without ``last``, which no one reads any more."""
    jvm = spark._jvm
    for place in _written[first:last]:
        path = jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    del _written[first:last]


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, size: int = 4 << 20) -> Iterator[None]:
    """Jobs run inside hand rows to Python tasks in Arrow batches of about ``size`` bytes at most.

    The usual 64 MB are held by the executor and by the worker, for every task
    at a time, and Python takes whole texts by a few rows anyway. A limit that
    the session has been given stays as it is.
    """
    if BATCH_BYTES in spark.conf.getAll:
        yield
        return
    spark.conf.set(BATCH_BYTES, str(size))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_BYTES)


def materialize(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder.

    Cuts the lineage: a lost executor costs no more than its own tasks, and
    later plans start from the size of the files.
    """
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/plumbline-{uuid.uuid4().hex}"
    _written.append(place)
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def materialize_from_texts(df: DataFrame) -> DataFrame:
    """The same for what Python tasks make of whole texts."""
    with small_batches(df.sparkSession):
        return materialize(df)


FILTER_BITS = 1 << 24
MAYBE_BITS = 1 << 21  # of a table that the plan, and so every task, carries: 256 kB


def hash_bits(ids: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """``bits`` bits, in words of 64, with those set that the hashes in the only column of ``ids`` name."""
    (name,) = ids.columns
    words = (
        ids.select(F.col(name).bitwiseAND(F.lit(bits - 1)).alias("place"))
        .select(
            F.shiftright("place", 6).alias("word"),
            F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"),
        )
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
    )
    table = np.zeros(bits // 64, dtype=np.int64)
    for word, held in words.collect():
        table[word] = held
    return table


def maybe_in(ids: DataFrame, bits: int = MAYBE_BITS) -> Callable[[Column], Column]:
    """A test on hashes: true for every one in the only column of ``ids``, and for some others.

    A table of ``bits`` bits, whatever the number of ids; a fuller one lets
    more rows through to the join that decides. Spark fills the table, one value
    that the plan carries, and the test is an expression.
    """
    (name,) = ids.columns
    place = F.col(name).bitwiseAND(F.lit(bits - 1))
    words = (
        ids.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(`{name}` & 63 as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
    )
    every = ids.sparkSession.range(bits // 64).select(F.col("id").alias("word"))
    dense = every.join(words, "word", "left").select("word", F.coalesce("bits", F.lit(0)).alias("bits"))
    table = materialize(dense.agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("t")).select("t.bits")).scalar()

    def maybe(hashes: Column) -> Column:
        word = F.get(table, F.shiftright(hashes.bitwiseAND(F.lit(bits - 1)), 6).cast("int"))
        return F.call_function("shiftright", word, hashes.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return maybe


def fresh(df: DataFrame, name: str) -> str:
    """``name``, changed as long as ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` and the ``index`` of each, from 0, in its ``group`` of ``n``; ``group`` is never null.

    Rows are dealt to ranges of (group, order), so that a group that holds most
    of them is spread over tasks, and equal rows too. Runs jobs.
    """
    tie, at, part, first, held = (fresh(rows, c) for c in ("tie", "at", "part", "first", "held"))
    keys = [group, *order, tie]
    ranged = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    table = materialize(ranged.drop(tie).withColumn(at, F.monotonically_increasing_id()))
    table = table.withColumn(part, F.shiftright(at, 33))
    # One row for each group and range that meet: as many as groups and tasks at most.
    ends = table.groupBy(group, part).agg(F.min(at).alias(first), F.count("*").alias(held))
    within = Window.partitionBy(group)
    before = F.sum(held).over(within.orderBy(part)) - F.col(held)
    counted = ends.select(group, part, (before - F.col(first)).alias(first), F.sum(held).over(within).alias("n"))
    return (
        table.join(materialize(counted), [group, part])
        .withColumn("index", F.col(at) + F.col(first))
        .drop(at, part, first)
    )
