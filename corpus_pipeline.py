"""A training-corpus pipeline: five stages, each by one of the corpus operators.

Every stage takes the documents that its predecessor wrote as Parquet and
returns a DataFrame; all but the last return the columns of ``documents``:

1. language ID: documents without any text in a language (no letter) go;
2. n-gram Jaccard join: of each group of copies and near copies the document
   with the smallest id stays;
3. secret scan: the secrets found are replaced by a mark in the text;
4. mixing: every document is emitted as often as the mix of sources takes it;
5. packing: the pieces of the documents in sequences of 2048 tokens.

All other columns pass through; ``n_chars`` follows the text where it changes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from equitylake.llm import jaccard, langid, mixing, packing, secrets
from equitylake.llm.common import staged


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; the rest (null text, no letter) is rejected."""
    return langid.keep_identified(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return jaccard.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    return secrets.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.emit(mixing.mix_sources(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify),
    ("jaccard_join", deduplicate),
    ("secret_scan", redact),
    ("mix_sources", mix),
    ("pack", pack),
]

#: no SQL can express the language, secret and packing models
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
