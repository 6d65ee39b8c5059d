"""The operators over their whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tramorisk.llm import additive, contentsort, jaccard, kernels, lattice, licences, maxent, mixing, pii, suffixes, tries, whitening, wumanber
from tramorisk.llm.oracles import ORACLE_SQL


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.repeated_spans(_table(spark, folder, "documents").select("doc_id", "text")).drop("spans")


def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.pii_report(_table(spark, folder, "documents"))


def op3_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return maxent.score_documents(_table(spark, folder, "documents").select("doc_id", "text"))


def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return wumanber.decontamination_report(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op5_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.vector_links(_table(spark, folder, "embeddings"))


def op6_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.licence_report(_table(spark, folder, "documents"))


def op7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, folder, "documents")).drop("copies")


def op8_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar_documents(_table(spark, folder, "documents").select("doc_id", "text"))


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    return kernels.language_report(_table(spark, folder, "documents"))


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    return additive.quality_report(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return tries.conversation_trie(_table(spark, folder, "conversations"))


def op12_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return contentsort.exact_copies(_table(spark, folder, "documents").select("doc_id", "text"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(_table(spark, folder, "embeddings").select("vec_id", "embedding"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_suffix_dedup, op2_pii, op3_lm_score, op4_decontaminate, op5_embedding_dedup, op6_licences, op7_mix,
                            op8_jaccard, op9_language, op10_quality, op11_prefix_trie, op12_exact_dedup, op13_whitening)}

__all__ = ["ORACLE_SQL", "QUERIES"]
