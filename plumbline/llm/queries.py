"""The operators applied to whole tables, as they are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from plumbline.llm import (
    ann,
    decontaminate,
    html_extract,
    jaccard_join,
    language,
    licenses,
    line_dedup,
    merkle,
    mixing,
    packing,
    quality,
    url_filter,
    whitening,
)
from plumbline.llm.common import ascii_lower, read_documents
from plumbline.llm.oracles import oracles


def op1_pareto_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(read_documents(spark, folder))


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read_documents(spark, folder), read_documents(spark, folder, "labels")
    weights = quality.fit_weights(docs, quality.trusted_ids(labels))
    return quality.score_quality(docs, weights)


def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_documents(spark, folder)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = language.fit(docs.where(~held_out & F.col("doc_id").isNotNull()))
    found = language.identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(read_documents(spark, folder))


def op5_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extract_text(read_documents(spark, folder, "pages"))


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge_urls(read_documents(spark, folder, "pages"))


def op7_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.near_duplicates(
        read_documents(spark, folder), jaccard_join.Rule(words=4, percent=85)
    )


def op8_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(read_documents(spark, folder, "embeddings"))


def op9_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(read_documents(spark, folder))


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup_lines(read_documents(spark, folder), passages=True)


def op11_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(read_documents(spark, folder), read_documents(spark, folder, "benchmark"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read_documents(spark, folder, "embeddings")
    model = whitening.fit(vectors)
    found = whitening.whiten(vectors, model)
    explained = F.array(*[F.lit(e) for e in model.explained]) if model else F.array().cast("array<double>")
    return found.select(
        "vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened")
    ).select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(model.n if model else None).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("place")).alias("explained"),
        F.lit(model.identity_error if model else None).cast("double").alias("identity_error"),
    )


def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_documents(spark, folder)
    fields = {name: F.col(name) for name in merkle.FIELDS}
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = merkle.digest_of((fields | {"text": ascii_lower(F.col("text"))}).values())
    manifest = merkle.build(
        docs,
        merkle.digest_of(fields.values()),
        group=F.col("lang"),
        order=F.col("doc_id"),
        payload={"doc_id": F.col("doc_id"), "tampered": F.when(touched, tampered)},
    )
    return manifest.proofs().select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        merkle.folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_pareto_mix,
        op2_quality,
        op3_language,
        op4_packing,
        op5_main_text,
        op6_url_filter,
        op7_jaccard_join,
        op8_nearest,
        op9_licenses,
        op10_line_dedup,
        op11_decontaminate,
        op12_whitening,
        op13_merkle,
    ]
    return {**{f.__name__: f for f in found}, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """Queries that SQL can express; the others are tested against brute force."""
    return oracles()
