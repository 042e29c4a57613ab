"""A training corpus from raw documents: each stage works on all rows that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from khata.llm import exact_dedup, jaccard_join, language_id, packing, secrets
from khata.llm.common import keep, table


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of no recognisable language: no letters, or less like their best language than
    nearly all labelled texts of that length.

    Profiles and bounds are learned from all labelled rows; with none, only letterless documents go.
    """
    return language_id.recognisable(docs)


def by_equality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts. A stage's docs are a table of Parquet files, so their rows need no numbers."""
    return exact_dedup.unique_documents(docs, stored=True)


def by_shingles(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each component of near copies."""
    return jaccard_join.one_of_each(docs, stored=True)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents and the sequences that they share."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", by_language),
    ("exact dedup", by_equality),
    ("n-gram Jaccard join", by_shingles),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language profiles, near copies, tokens and packing are not expressed in SQL.
ORACLE_SQL = None
