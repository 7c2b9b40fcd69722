"""The corpus pipeline: quality, near-duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of ``documents``. A stage's result is to be written, and read again as the next stage's ``docs``: the scratch tables of
a stage are deleted when the next one begins.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import packing, quality, queries, secrets, simhash, suffix_dedup
from tidemark.plans import shared

#: Passages of 50 words are to be found: in words of this language family they have 250 bytes or more. Anchors are chosen
#: among strings of a third of that, so that a window has room for several.
PASSAGE_BYTES, PASSAGE_GRAM = 250, 80
_left_over: list[str] = []


def _stage(function):
    """Drop what earlier stages left in the shared folder, and remember what this one leaves."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _left_over:
            shared.delete(spark, _left_over.pop())
        with shared.recorded() as made:
            result = function(spark, docs, sf_dir)
        _left_over.extend(made)
        return result

    run.__name__, run.__doc__ = function.__name__, function.__doc__
    return run


@_stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the compression classifier accepts (score 0.7 or more)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").cast("int").alias("label"))
    model = quality.train(docs.where(~quality.held_out(docs["doc_id"])), labels)
    return quality.accepted(docs, model)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near-duplicates."""
    return simhash.keep_first(docs)


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out what strings of PASSAGE_BYTES cover that start anywhere else; every document stays."""
    return suffix_dedup.without_repeats(docs, length=PASSAGE_BYTES, gram=PASSAGE_GRAM).withColumn("n_chars", F.length("text").cast("long"))


@_stage
def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets; every document stays."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


@_stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokenised documents into sequences of at most 2048 tokens."""
    return packing.pack(docs, queries._path(".json"), capacity=2048)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", repeated_passages),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: The stages train, hash and tokenise: nothing that SQL expresses. tests/llm holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a Parquet table in the shared folder."""
    folder = f"{shared.shared_root(spark)}/tidemark-pipeline-{uuid.uuid4().hex[:12]}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            shared.delete(spark, before)
        before = path
    return docs
