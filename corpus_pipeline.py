"""A training corpus out of the table documents, in five stages that each read what the one before has written.

Each stage takes any table with doc_id and text (the last with source too), nulls in any column, blank and very long
texts, repeated rows, other columns of any name, and no rows at all; what comes out in each case is said in the
docstring of the operator's ``stage``. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, line_dedup, mixing, quality_rules, simhash_dedup
from tidemark.llm.common import discard, materialise, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base checks or the learned decision list reject go; null and blank texts are among them."""
    return quality_rules.stage(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that other documents keep; a document that loses all it has goes, one without lines stays."""
    return line_dedup.stage(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays, of the smallest doc_id; rows without an id are told apart by text."""
    return simhash_dedup.stage(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; without items all stay."""
    return decontaminate.stage(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's documents, with the weight of their source and how often the mixture holds them."""
    return mixing.stage(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixture),
]

#: A learned list and fingerprints can't be said in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, name)
            if before is not None:
                discard(before)
            before = docs
    return docs
