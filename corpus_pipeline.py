"""Training text preparation: quality rules, near-duplicates, benchmark passages, secrets, token ids."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tailfield.llm import contamination, near_duplicates, pieces, quality, secrets
from tailfield.llm.queries import piece_model
from tailfield.session import scratch_dir


# Texts that go to or come from Python at once. The default of 10,000 rows is tens of megabytes in the executor, outside its
# heap, and again in each worker, which stays for the next stage; whole rows are sent all the same.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def small_batches(spark: SparkSession) -> None:
    for name, value in BATCH.items():
        spark.conf.set(name, value)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    small_batches(spark)
    return quality.keep_quality(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 percent of its runs of five words: the one with the smallest id."""
    small_batches(spark)
    return near_duplicates.keep_first(docs, 80, 5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    small_batches(spark)
    return contamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts."""
    small_batches(spark)
    return secrets.redact_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's token ids, and the digest of what they decode to."""
    small_batches(spark)
    return pieces.sentencepiece_round_trip(docs, piece_model())


STAGES = [
    ("quality rules", keep_quality),
    ("near-duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("token ids", encode),
]

# Novelty of a string and the merges of a vocabulary have no SQL form; tests/llm checks the rows against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again before the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{scratch_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
    return docs
