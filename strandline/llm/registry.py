"""Queries of this subpackage and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, covertree, exact_dedup, jaccard, langid, mixing, ngramlm, pieces, secrets, toxicity
from .common import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.neighbours(table(spark, sf_dir, "conversations"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramlm.score(table(spark, sf_dir, "documents"))


def op10_embedding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_pairs(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sentencepiece, op2_exact_dedup, op3_secret_scan, op4_language_id, op5_preference_format, op6_mix_sources, op7_jaccard_join, op8_toxicity, op9_class_lm, op10_embedding_pairs)
}
ORACLES: dict[str, str] = {"op2_exact_dedup": exact_dedup.SQL, "op5_preference_format": chat.SQL, "op6_mix_sources": mixing.SQL, "op7_jaccard_join": jaccard.SQL, "op10_embedding_pairs": covertree.SQL}
