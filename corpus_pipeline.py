"""The corpus pipeline: five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``.  All but the last return
the columns of ``documents``; the last one repeats documents and adds ``copy``.

Defined results, of which each operator's docstring says more: rows with null or
empty texts are rejected by the quality rules; null and repeated ids stay rows of
their own, rows equal in id and text are near copies, of which one stays; ties go
to the smallest id; texts of any length are read whole; an empty table gives an
empty result in every stage; other columns, whatever their names, are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postroom.llm.common import mark, release, stored, table
from postroom.llm.decontamination import drop_leaks
from postroom.llm.line_dedup import deduplicated
from postroom.llm.minhash_dedup import drop_near_duplicates
from postroom.llm.mixing import mixed
from postroom.llm.quality_rules import keep_good


#: Rows of whole documents in an Arrow batch, of which a task holds some at a time, here and in Python.
BATCH = 1000


def in_small_batches(spark: SparkSession) -> None:
    """Stages that pass whole texts through Python: all of a pipeline's stages share the executors' memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the posterior reject go."""
    in_small_batches(spark)
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of like lines the first stays; documents that lose all their lines go."""
    return deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (five words, 0.8) one document stays."""
    in_small_batches(spark)
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or a re-parameterised one, go."""
    in_small_batches(spark)
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their targets."""
    return mixed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: EM, MinHash components and template matching are not SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = mark()
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        release(before, keep=1)  # what the stage wrote on its way, and its input
    return STAGES[-1][1](spark, docs, sf_dir)
