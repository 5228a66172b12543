"""Corpus preparation: documents to tokens in five stages, each an operator of jobloom.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the last return the
columns of documents.  Nulls, empty texts, repeated rows and further columns are treated as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from jobloom.llm import bpe, decontam, jaccard, langid, quality
from jobloom.llm.common import release, stored, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be of low quality go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose words agree on no language, go."""
    return langid.accepted(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document with the smallest doc_id stays.

    SimHash fingerprints meet in op1's byte-position index and are checked by whole sets; an exact index over shingles
    finds the pairs that 64 bits can't reach (README).
    """
    return jaccard.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text that they decode to."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), ids=True)


STAGES = [("quality", quality_stage), ("language", language_stage), ("near_duplicates", near_duplicate_stage), ("decontamination", decontamination_stage), ("tokens", token_stage)]

#: The classifiers, the field and the merges aren't SQL: tests/llm hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written as Parquet and read again; a stage's scratch tables go when it is done."""
    docs, before = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        release(spark, before | {docs.jobloom_path})
    return STAGES[-1][1](spark, docs, sf_dir)
