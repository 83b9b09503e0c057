"""A training corpus from `documents`, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read
again as the next one's docs. All but the last return the columns of documents:
documents of low quality go, one document of each group of near duplicates stays,
documents that hold a benchmark passage go, secrets are replaced by a mark, and what
is left is packed into sequences.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._spark import drop_folder, shared_folder, table
from tidemark.llm.decontamination import keep_clean
from tidemark.llm.near_dedup import keep_one
from tidemark.llm.packing import pack
from tidemark.llm.quality import keep_good, train
from tidemark.llm.secret_scan import redact


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of ACCEPT and more, all their columns as they are, whatever these are called.

    Null and empty texts are scored as empty texts, very long ones whole; null ids are
    scored and never learned from; repeated rows have one score and stay or go together; a
    score equal to ACCEPT stays. No documents give none, and without labels all go.
    """
    return keep_good(docs, train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8), the one with the least doc_id.

    Null, empty and blank texts are alike to nothing and stay. Rows that share a doc_id are
    one document and stay or go together; rows without one stay. Very long texts are
    compared whole. No documents give none; all columns stay as they are.
    """
    return keep_one(docs, shingle=5, threshold=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark.

    Null and empty texts and null ids stay; repeated rows are judged each; very long texts
    are read whole. No documents give none, no items remove none; all columns stay.
    """
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark, n_chars counted anew.

    Null texts stay null, and n_chars with them; null ids, repeated rows and other columns
    stay; very long texts are read whole. No documents give none.
    """
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids, each a sequence of its own, by buckets of equal length.

    A null or empty text is its end token alone; null ids stay, repeated rows are packed
    each; a very long text is as many full sequences as it takes. No documents give none.
    """
    pieces = pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: SQL can't express the classifier or the tokenizer; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each result but the last written to the shared folder; of these one is kept at a time."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            drop_folder(spark, f"{folder}/{k - 1}")
    return docs
