"""A corpus pipeline: from raw documents to packed windows of token ids.

Each stage is ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and
returns a DataFrame, which is written as Parquet and reread as the next one's
``docs``. All but the last return the columns of ``documents``.

Defined cases are those of the operators: texts that are null or have no letter go
in the first stage, so the later ones see letters only; ties keep the smallest id;
an empty table runs through to an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from runlens.llm.exact_dedup import drop_exact_duplicates
from runlens.llm.language_id import MIN_KNOWN, fit_languages, keep_identified
from runlens.llm.minhash_dedup import drop_near_duplicates
from runlens.llm.packing import pack_documents
from runlens.llm.secret_scan import redact_secrets
from runlens.sources.storage import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the labelled languages, by the words and n-grams it holds."""
    return keep_identified(docs, fit_languages(docs), min_known=MIN_KNOWN)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the smallest id."""
    return drop_exact_duplicates(docs)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest id."""
    return drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids and their places in windows of 1,024 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("minhash_dedup", minhash_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

# Fitted models, components and vocabularies are beyond SQL; tests/llm/test_pipeline.py
# compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        found = materialize(stage(spark, found, sf_dir), f"pipeline-{name}")
    return found
