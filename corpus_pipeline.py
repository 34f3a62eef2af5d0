"""A corpus pipeline: every stage reads what the one before it wrote.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last
return the columns of ``documents``, and further columns of any name that docs
may have.  Small reference tables (labels, the benchmark) are read from sf_dir.

Defined results of all stages: an empty table gives an empty one.  Rows with
null doc_id are kept, except where their own text is judged.  Only doc_id,
text and n_chars of docs are read or changed by name (lang too, in learning).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.llm import decontamination, line_dedup, ngram_join, packing, toxicity
from voxelframe.llm.queries import LABEL_FOLD
from voxelframe.llm.shared import Scratch, small_batches, without

#: Shorter lines are a word or two, a number or a date, and one edit makes another of them ("Chapter 12", "2024-01-05").
NEAR_CHARS = 12


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go.  Each row is judged by its text alone: null and empty texts count as a text without words (kept, unless most labelled texts are toxic), rows that repeat go or stay together, texts are read whole."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(f"not ({LABEL_FOLD})").select("doc_id", F.col("toxic").alias("label"))
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go, from NEAR_CHARS characters on also those within one edit of one; blank lines and all documents stay.  Null texts stay null, a text whose lines all go becomes empty, the earliest line by doc_id and place stays, rows that share a doc_id do not remove each other's lines, rows without doc_id are left as they are."""
    small_batches(spark)
    return line_dedup.line_dedup(docs, NEAR_CHARS, counted=None)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id stays.  Rows of that doc_id all stay, also if they repeat; null and empty texts and rows without doc_id are in no group and stay."""
    small_batches(spark)
    return without(docs, ngram_join.similar_groups(docs).where("component_id <> doc_id").select("doc_id"))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go.  Null and empty texts hold none; rows that share a doc_id are judged as one and go together; rows without doc_id stay."""
    small_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without(docs, decontamination.contaminated(docs, benchmark).select("doc_id").distinct())


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids: one row per piece.  Null texts are packed as empty ones (the end id alone), rows that repeat are packed each, only texts over 2048 ids are cut."""
    small_batches(spark)
    return packing.best_fit_packing(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", clean),
    ("line_dedup", distinct_lines),
    ("ngram_jaccard", one_of_each),
    ("decontamination", uncontaminated),
    ("packing", packed),
]

#: Learned scores and token ids are beyond SQL; the tests compare each stage with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"{i}_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
