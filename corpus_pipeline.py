"""Corpus preparation: five operators in a row, each over all documents that the one before it kept.

Toxic documents go; one document of each group of near-duplicates stays; passages of 50 bytes or more that also stand in
a document with a smaller id go; secrets are replaced by their kind; what is left is packed into sequences.
All stages but the last return the columns of documents. SQL can't state the first stage (a fitted model).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citeweave.llm.bpe import vocabulary
from citeweave.llm.common import read, stored
from citeweave.llm.packing import pack, pieces
from citeweave.llm.secrets import redacted
from citeweave.llm.simhash import one_of_each
from citeweave.llm.suffixes import dedup_texts
from citeweave.llm.toxicity import accepted, train

ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted(docs, train(docs, read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_texts(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(stored(pieces(docs, vocabulary("byte_bpe_50k.tiktoken")), "pieces"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("secrets", secrets),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
