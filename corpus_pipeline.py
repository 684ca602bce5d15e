"""A corpus pipeline: documents in known languages, without copies, mixed by source, segmented."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import exact_dedup, jaccard, langid, mixing, pieces
from strandline.llm.common import discard, stored, table


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.known_documents(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.kept_documents(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies: five-word shingles, similarity of 0.8 or more."""
    return jaccard.first_of_each(docs, k=5, percent=80)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def segmented(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces, lossless of every document."""
    return pieces.encode(docs)


STAGES = [
    ("language id", known_languages),
    ("exact dedup", without_copies),
    ("n-gram jaccard join", without_near_copies),
    ("mixing to target weights", mixed_sources),
    ("sentencepiece", segmented),
]

#: Language identification and sampled segmentation have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = first = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        if before is not first:
            discard(before)
    return docs
