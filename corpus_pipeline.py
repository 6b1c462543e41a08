"""The corpus pipeline: language, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept,
as written and read again. All but the last return the columns of ``documents``.

Nulls, empty texts, repeated rows and empty tables are what the operators in
``lumenvault.llm`` say of them; extra columns of docs pass through all stages but
the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenvault.llm import decontaminate, language_id, packing, recompression, simhash
from lumenvault.llm.common import checkpoint_dir, crc_remainder, drop_path, table, written

#: No SQL expresses language identification, SimHash groups or packing.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without a letter, or without a language, go."""
    model = language_id.learn(docs.where(F.coalesce(crc_remainder(F.col("doc_id")), F.lit(0)) != 2))
    return language_id.keep_known(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id."""
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages of 35 words or more that occur elsewhere too."""
    return recompression.without_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no test item of five words or more; shorter ones stand in clean documents by chance."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), overlap=decontaminate.Overlap(min_item=5))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read by the next; what the last one reads no more is deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{k}-{name}")
        if before:
            drop_path(spark, before)
        before = f"{folder}/{k}-{name}"
    return docs
