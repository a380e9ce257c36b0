"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidework.llm import mixing, ngram_join, packing, quality, secret_scan
from tidework.llm.common import read, saved


def good_quality(spark: SparkSession, documents: DataFrame, folder: str) -> DataFrame:
    """Documents the quality classifier accepts, learned from all labels; a row goes or stays by its own text."""
    labels = read(spark, folder, "labels")
    source = read(spark, folder, "documents")
    return quality.accepted(documents, quality.fit(source, labels))


def without_copies(spark: SparkSession, documents: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more."""
    return ngram_join.one_of_each(documents)


def without_secrets(spark: SparkSession, documents: DataFrame, folder: str) -> DataFrame:
    """All documents, with a mark in place of each secret and ``n_chars`` of the text that is left."""
    return secret_scan.masked(documents, length="n_chars")


def mixed(spark: SparkSession, documents: DataFrame, folder: str) -> DataFrame:
    """Documents as often as the mixture takes them: none, one or two equal rows each."""
    return mixing.resampled(documents)


def packed(spark: SparkSession, documents: DataFrame, folder: str) -> DataFrame:
    """A row for each piece of each document, with its place in a sequence of 2048 tokens."""
    return packing.pack(documents)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", good_quality),
    ("ngram_jaccard_join", without_copies),
    ("secret_scans", without_secrets),
    ("mixing_to_target_weights", mixed),
    ("best_fit_packing", packed),
]

# The first stage is a trained network, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; what each returns is a table in the shared work folder."""
    documents = read(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        documents = saved(stage(spark, documents, folder), name)
    return STAGES[-1][1](spark, documents, folder)
