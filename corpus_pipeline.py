"""A corpus from raw documents to packed sequences: each stage is written as Parquet and read again as the next one's documents.

For every stage: a null text counts as empty; a null doc_id is no smaller than any other; equal rows tie, and where one of them is to stay any one does; texts are worked on
whole, at any length; an empty table gives an empty table; all columns of the documents pass through all stages but the last, whatever their names.

A stage begins by deleting the scratch tables that earlier stages of this process left, unless its documents read them: write a stage's result before the next one starts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import common, lgs_pack, line_align, phrase_automata, shingle_sets, weak_rules

#: Near-duplicates in the pipeline: five-word shingles of this similarity or more; SimHash links up to so many differing bits are candidates.
NEAR_BITS, NEAR_SHINGLE, NEAR = 6, 5, 0.8


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Scratch tables of the stages that have run.
LEFT: list[str] = []


def stage(work: Stage) -> Stage:
    """Before the stage's work what earlier stages left goes; what it writes itself is noted."""

    @wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.drop_unread(docs, LEFT)
        n = len(common.MADE)
        out = work(spark, docs, sf_dir)
        LEFT.extend(common.MADE[n:])
        return out

    return run


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality probability is high enough, unchanged. Null, empty and short texts fail the base rule and go; repeated rows share their fate."""
    return weak_rules.keep_good(docs)


@stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, later ones without the line blocks that they share with earlier ones. Null texts stay null; of repeated rows all but one lose their lines."""
    return line_align.deduplicated(docs).select("row.*")


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate group, unchanged. Null and empty texts are one group; rows with a null doc_id come last in theirs."""
    return shingle_sets.keep_one_per_group(docs, NEAR_BITS, NEAR_SHINGLE, NEAR)


@stage
def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without passages of 35 words and more that stand elsewhere too. Null texts stay null."""
    return phrase_automata.deduplicated(docs).select("row.*")


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences; a null or empty text is one piece, the end id."""
    return lgs_pack.packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", substrings),
    ("best_fit_packing", packing),
]

#: Token ids and patience alignment are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{common.scratch_dir(spark)}/textloom-pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, work in STAGES:
        work(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
