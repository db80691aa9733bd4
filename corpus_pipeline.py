"""From raw documents to packed sequences: the stages of the corpus pipeline.

Each stage takes and returns whole tables of documents; rows of any content
and columns of any name pass, and empty tables stay empty. What a stage does
with nulls, empty texts, ties and repeated rows stands with the function of
``plumbline.llm`` that it calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import mixing, packing, quality, stages
from plumbline.llm.common import discard, materialize, read_documents, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the quality rules; those without a text do not."""
    labels = read_documents(spark, sf_dir, "labels")
    weights = quality.fit_weights(docs, quality.trusted_ids(labels))
    return quality.keep_good(docs, weights)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that stand elsewhere already, and without those of which too little is left."""
    return stages.without_repeated_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return stages.one_of_each_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in their sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("jaccard_join", drop_near_duplicates),
    ("mix", mix_sources),
    ("packing", pack),
]

# Line chunks, similarity links and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written before the next stage reads it.

    Tables that a stage has written for itself, and its input, go as soon as its
    result is there; the last stage's stay, as its result reads them.
    """
    docs = read_documents(spark, sf_dir)
    first = written()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
            discard(spark, first, written() - 1)
    return docs
