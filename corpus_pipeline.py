"""From raw documents to packed token sequences: five stages, each on all that the one before it kept.

A document whose language is rejected or that scores as toxic goes; of equal texts, and then of near copies, one stays;
what is left is encoded and packed. Every stage but the last returns the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm import exact_dedup, jaccard_join, language_id, packing, toxicity
from terrafold.llm.common import held_out, materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are in no learned language (no letters, or far from every model)."""
    model = language_id.fit(docs.where(~held_out("doc_id", 4, 2)))
    return language_id.keep_languages(docs, model)


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic, by a lexicon learned from the labels of documents still here."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id", 4, 2))
    return toxicity.keep_harmless(docs, toxicity.fit(docs, labels))


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each set of equal texts."""
    return exact_dedup.drop_copies(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near copies: five-word shingles, similarity of 0.8 or more."""
    return jaccard_join.drop_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: each piece's document, ids, sequence and offset there."""
    return packing.pack(docs).select("doc_id", "piece", "start", "length", "sequence_id", "offset", "ids")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_languages),
    ("toxicity", remove_toxic),
    ("exact_dedup", remove_copies),
    ("jaccard_join", remove_near_copies),
    ("packing", pack),
]

#: Learned models and packing have no SQL form. Tests hold exact and near copies against brute-force versions, and toxicity
#: against a plain version that tells sure hits and sure misses (what quotation decides lies between); languages are
#: tested by held-out rows and a few texts of no known language, packing by ids, lengths and the limit of a sequence.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
