"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, secret
scans and BPE encoding, each stage on all that the one before it kept.

    run(spark, sf_dir)

Every stage's rows are written as Parquet to the shared folder and read again, so a
lost executor costs a stage's tasks at most, and the next stage starts from files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from txnlens.llm.bpe import bpe_digest
from txnlens.llm.common import table, written
from txnlens.llm.decontam import decontaminated
from txnlens.llm.near_dup import without_copies
from txnlens.llm.queries import WORD_BPE
from txnlens.llm.secret_scan import redact_secrets
from txnlens.llm.toxicity import fitted, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents predicted toxic. The model learns from the labelled rows of
    the stage's own documents."""
    return without_toxic(docs, fitted(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group, one with its least doc_id; rows that repeat a
    doc_id go by their own texts. Documents without words or without an id stay."""
    return without_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark windows cover a twentieth or more."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document; secrets in its text are replaced."""
    return redact_secrets(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns but the text, with the digests of its tokens."""
    return bpe_digest(docs, WORD_BPE, keep=tuple(c for c in docs.columns if c != "text"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("encoding", encoding)]

#: A trained network and merges are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
