"""What a pipeline does with the operators' answers: which documents go, and which of a group stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from plumbline.llm import jaccard_join, line_dedup
from plumbline.llm.common import fresh, materialize, maybe_in, words_of


def without_repeated_lines(docs: DataFrame, least_words: int = 20) -> DataFrame:
    """``docs`` without the chunks and passages of lines that stand elsewhere already.

    A text that loses lines and has fewer than ``least_words`` words left goes as
    a whole: what it said stands elsewhere. Texts that lose nothing stay as they
    are, short, empty and null ones too. ``n_chars`` follows the text where there
    is such a column; all other columns stay, whatever they are called, and an
    empty table stays empty.
    """
    cut = line_dedup.dedup_lines(docs, passages=True)
    lost = F.col(cut.columns[len(docs.columns) + 1]) > 0
    left = cut.where(~lost | (F.size(words_of(F.col("text"))) >= least_words)).select(*[F.col(f"`{c}`") for c in docs.columns])
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.char_length("text").cast("bigint"))
    return left


def one_of_each_group(docs: DataFrame, rule: jaccard_join.Rule = jaccard_join.Rule(words=5, percent=80)) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest id, nulls last.

    Documents without an id are told apart by numbers above all ids, which must
    fit a bigint. Of rows with equal id and text the one with the smallest other
    columns stays; different texts of one id are one document and stay together.
    A text without words is in no group. Columns of any name and type are kept;
    an empty table stays empty.
    """
    key, other = fresh(docs, "group_id"), fresh(docs, "gone_id")
    last = docs.agg(F.max("doc_id")).first()[0]
    number = F.monotonically_increasing_id() + F.lit(0 if last is None else last + 1).cast("bigint")
    unknown = materialize(docs.where("doc_id IS NULL").withColumn(key, number))
    rows = docs.where("doc_id IS NOT NULL").withColumn(key, F.col("doc_id").cast("bigint")).unionByName(unknown)
    found = jaccard_join.near_duplicates(rows.select(key, "text"), rule, id_column=key)
    gone = materialize(found.where(f"{key} != component_id").select(F.col(key).alias(other)).distinct())
    hit = maybe_in(gone.select(F.xxhash64(other)))(F.xxhash64(key))
    kept = rows.where(hit).join(gone, F.col(key) == F.col(other), "left_anti")
    return _once(rows.where(~hit).unionByName(kept), key).select(*[F.col(f"`{c}`") for c in docs.columns])


def _once(rows: DataFrame, key: str) -> DataFrame:
    """Rows of equal ``key`` and text once; texts of other ids never leave their place."""
    counts = rows.groupBy(key, F.xxhash64("text").alias("digest")).agg(F.count("*").alias("times"))
    again = materialize(counts.where("times > 1").select(key).distinct())
    hit = maybe_in(again.select(F.xxhash64(key)))(F.xxhash64(key))
    rest = [f for f in rows.schema.fields if f.name not in (key, "text")]
    order = F.struct(*[_ordered(F.col(f"`{f.name}`"), f.dataType) for f in rest])
    whole = F.struct(*[F.col(f"`{f.name}`") for f in rest])
    one = rows.where(hit).groupBy(key, "text").agg(F.min_by(whole, order).alias("rest"))
    return rows.where(~hit).unionByName(one.select(key, "text", *[F.col(f"rest.`{f.name}`") for f in rest]))


def _ordered(value: Column, kind: DataType) -> Column:
    """A value that has an order: maps have none, their text has."""

    def has_none(kind: DataType) -> bool:
        if isinstance(kind, ArrayType):
            return has_none(kind.elementType)
        if isinstance(kind, StructType):
            return any(has_none(f.dataType) for f in kind.fields)
        return isinstance(kind, (MapType, VariantType))

    return value.cast("string") if has_none(kind) else value
