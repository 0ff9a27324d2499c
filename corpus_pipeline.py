"""The corpus pipeline: from raw documents to packed token sequences.

Each stage works on all that the one before it kept; ``run`` writes every
stage's result to the shared checkpoint folder as Parquet and reads it again
as the next stage's documents.

Null texts have no language and go; rows with a null doc_id pass all stages
as they are; repeated rows stay together or go together; rows that repeat a
doc_id with another text are documents of their own; further columns pass, but
for the last stage's; texts of any length are taken whole; an empty table
gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import langid, packing, simhash, suffixes
from tessera.llm.common import shared_folder
from tessera.sources.shared import scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go (null and letterless texts among them)."""
    return langid.known_language(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of exact and near copies the document with the smallest doc_id stays.

    Near: 0.8 and more of the different five-word shingles are shared.
    """
    return simhash.near_dedup(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that a document with a smaller doc_id has are cut out."""
    return suffixes.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their places in sequences."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("SimHash near-dedup", near_copies),
    ("suffix-array dedup", repeats),
    ("best-fit packing", packed),
]

#: SQL can't express the stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; an empty table gives an empty result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark):  # what a stage puts aside goes as soon as its result is written
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
