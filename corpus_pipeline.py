"""A corpus pipeline of the text operators: language, exact copies, near copies, secrets, packing.

Every stage takes rows with nulls in any column, rows that repeat, and columns of any other name, which pass through all
stages but the last.  A null text counts as empty, has no language and goes with the first stage; a row without a doc_id
cannot be named by a decision, so no deduplication drops it.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import materialize, read_table, release
from tessera.llm.exact_dedup import deduplicate
from tessera.llm.language_id import drop_rejected, fit
from tessera.llm.near_copies import drop_near_copies
from tessera.llm.packing import default_vocabulary, pack_documents
from tessera.llm.secrets import redact


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects go; it is trained on a bounded sample of the stage's own input.

    Texts that are null or hold no letter are rejected, and those whose calibrated score is below the fitted threshold.
    """
    return drop_rejected(docs, fit(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the longest in its own spelling, of these the smallest doc_id."""
    return deduplicate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest doc_id.

    Shingles of five words and a similarity of 0.8, found by SimHash and its covering tables, verified on the shingles.
    """
    return drop_near_copies(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; the secrets found in it are masked."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 2048 tokens."""
    return pack_documents(docs, default_vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("secrets", secrets), ("packing", packing),
]

#: Language, near copies and tokens have no SQL form; ``tests/llm/test_pipeline.py`` holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again as the next one's input."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        release(before)
    return docs
