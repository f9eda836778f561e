"""A corpus pipeline over ``documents``: five stages, each one operator, each written before the next reads it.

quality classifier -> exact deduplication -> near-deduplication -> mixing to target weights -> BPE encoding.
All but the last return the columns of documents; the last returns the documents' columns without the text,
with their token ids and digests.

Each stage handles odd rows as its operator's docstring states.  A null text is an
empty one and a null doc_id is a row like any other: neither is dropped for being so,
but empty texts are equal, so one of them passes the second stage.  Ties: of equal
texts the largest doc_id stays, of near copies the smallest; rows that repeat the
kept doc_id and text all stay.  Empty tables give empty results.  Columns of
documents beyond those used pass through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import bagminhash, bpe, exact_dedup, mixing, quality
from barloom.llm._io import dropped, released, ship, staged, table, written
from barloom.llm.queries import pattern, ranks_file

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exact_dedup.survivors(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near copies."""
    return bagminhash.representatives(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents by source, at the default target weights, globally shuffled."""
    return mixing.mix(docs, extra=False)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and digests of ids and decoded bytes."""
    return bpe.encode(docs, ranks_file(), pattern=pattern())


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: SQL cannot express the classifier, the signatures or the encoding; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again.

    What a stage wrote on its way goes once its result is written, and so does the result before it.
    """
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        since, before = written(), docs
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        released(spark, since, docs)
        dropped(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
