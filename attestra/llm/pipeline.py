"""The corpus pipeline: quality rules, toxicity, near-duplicates, personal data, packing.

Each stage works on all rows that its predecessor kept and returns the columns of documents (the
last one returns pieces in sequences). Between stages ``run`` writes Parquet in the shared folder and
reads it again, so a lost executor repeats a task, not the pipeline; what a stage has read is removed
once the next one is written, and what it has kept for itself once it is written.

Defined results, for every stage: null texts are empty ones, which the first stage removes and the
others keep as they are; rows without an id are rows like others; repeated rows are judged alike (the
third stage keeps one of them); an empty table gives an empty one; columns other than ``COLUMNS`` are
not passed on; very long texts are worked on as a whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import packing, pii, quality_rules, resemblance, toxicity
from .store import KEPT, released, removed, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and the classifier. It is fitted on the labelled rows of the documents table."""
    model = quality_rules.learn(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.filtered(docs.select(*COLUMNS), model)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    model = toxicity.learn(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.filtered(docs.select(*COLUMNS), model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies (five-word shingles, similarity 0.8): the one with the smallest id, nulls last. An id may stand on rows of several classes; each class keeps its row."""
    return resemblance.distinct_rows(docs.select(*COLUMNS), list(COLUMNS))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text."""
    return pii.redacted(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents: doc_id, piece, start, length, ids, sequence_id and offset."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality_rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the classifiers nor the packing rule.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        mark = len(KEPT)
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        released(spark, mark)  # what the stage has kept for itself
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            removed(spark, before)
        before = f"{folder}/{name}"
    return docs
