"""From raw documents to a training mix: five stages, each on all that the one before kept.

A stage is a function ``(spark, docs, sf_dir) -> DataFrame``; its result is
written to the shared folder and read again as the next stage's ``docs``.  All
but the last return the columns of ``documents``.  Empty inputs, nulls and
repeated rows pass as the operators define it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, linededup, mixing, quality, simhash
from millrace.llm.common import table
from millrace.session import materialize


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the classifier rejects: poor, toxic and blank texts."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut lines that repeat an earlier one within one edit; a document with nothing left goes."""
    cut = linededup.dedup_lines(docs).filter(F.col("text").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return cut.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else cut


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group whose fingerprints link: shingles of four words, at most four differing bits."""
    return simhash.without_near_duplicates(docs)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their size, their source's target, and the words that the mix takes of them."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_text),
    ("mixing sources to target weights", mix_sources),
]

# Hashed features, vantage-point trees and XXH64 are not to be had in SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
