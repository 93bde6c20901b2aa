"""The corpus pipeline: language ID, near-dedup, decontamination, mixing and sharding of documents.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns a DataFrame; it is
written as Parquet in the shared folder and read again as the next one's docs. All but the last return the columns of
documents. Stages follow the documents' own columns: doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import decontam, langid, minhash, mixing, sharding
from quillstone.llm.common import fold, materialize, table

#: Documents whose language is less sure than this are rejected, as are those without letters.
LEAST_SCORE = 0.5
SHARDS = 8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is identified with a score of LEAST_SCORE or more; lang is then the identified one."""
    train = docs.filter(fold(F.col("doc_id"), 5) != 0)
    return langid.keep_identified(docs, train, LEAST_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: five-word shingles, similarity 0.8."""
    return minhash.deduplicate(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark item is found."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as its source's target weight asks, in a global shuffle."""
    return mixing.mixed_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every row in one of SHARDS shards of nearly equal bytes."""
    return sharding.assign_shards(docs, shards=SHARDS, keep=("doc_id", "lang", "source"))


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard),
]

#: Language models and min-max signatures can't be expressed in SQL; tests/llm/test_pipeline.py holds each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
