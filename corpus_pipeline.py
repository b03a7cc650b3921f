"""The corpus pipeline: ``STAGES`` in order over the documents.

Each stage gets what the one before kept and returns it with the columns of documents; the last
says how many words the mix takes of each document that is left.

Each stage takes nulls in any column, empty and very long texts, ties, repeated rows and empty
tables as its operator's module says, and passes on further columns as they are: a null text is
an empty one, a null doc_id comes after all others, and rows that are equal stay or go together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from utterance_guard.llm.common import table, written
from utterance_guard.llm.decontaminate import without_leaks
from utterance_guard.llm.exact_dedup import keep_first
from utterance_guard.llm.mixing import mix_sources, taken_words
from utterance_guard.llm.quality import keep_good
from utterance_guard.llm.simhash import keep_smallest

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, table(spark, folder, "labels"))


def exact(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies stays, by the rule of the SimHash operator."""
    return keep_smallest(docs)


def benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return without_leaks(docs, table(spark, folder, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """``doc_id, size, source_size, target, taken``."""
    return taken_words(mix_sources(docs))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("benchmark_decontamination", benchmark),
    ("mixing", mixing),
]

#: Neither the fitted classifier nor the drawn mix can be said in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, folder), name)
    return docs
