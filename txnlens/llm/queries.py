"""The registered queries of the operators."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import url_filter
from .bpe import bpe_digest
from .chat import assembled, read_back
from .common import crc_mod, table
from .decontam import ONE_IN, WINDOW, benchmark_hits
from .frames import token_files
from .lm import lm_scores
from .near_dup import PERCENT, SHINGLE, near_duplicates
from .oracles import all_oracles
from .pii import pii_digest
from .prefix_trie import prefix_trie, ranked, respliced_rows
from .runs import periodic_runs, run_digest, spliced
from .secret_scan import scan_secrets
from .topk import K, SCALE, top_k
from .toxicity import HELD_OUT, fitted, score_toxicity

#: Folder of the public vocabulary files.
TOKENIZERS = os.environ.get("TXNLENS_TOKENIZERS", "/opt/tokenizers")
WORD_BPE = f"{TOKENIZERS}/word_bpe_49k.json"
BYTE_BPE = f"{TOKENIZERS}/byte_bpe_50k.json"
END_ID = 2
QUERY_STEP = 20
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(table(spark, sf_dir, "documents"), WORD_BPE)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.sql("SELECT -1L AS conv_id, turn, role FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)").withColumn("text", F.lit(CONTROL_TEXT))
    return read_back(assembled(turns.union(own), BYTE_BPE), BYTE_BPE)


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % QUERY_STEP == 0))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fitted(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", HELD_OUT) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op10_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), WORD_BPE, END_ID)


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(table(spark, sf_dir, "documents"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digest(periodic_runs(table(spark, sf_dir, "documents"), change=spliced))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(respliced_rows(ranked(table(spark, sf_dir, "conversations"))))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_chat, op3_topk, op4_lm, op5_secrets, op6_decontam, op7_urls, op8_near_dup, op9_toxicity, op10_frames, op11_pii, op12_runs, op13_prefix_trie)}
ORACLES = all_oracles(CONTROL_TEXT, K, SCALE, QUERY_STEP, WINDOW, ONE_IN, SHINGLE, PERCENT)
