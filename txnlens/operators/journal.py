"""The resumable work table: a journal of finished records, the last record
per key winning, the pending set, and pairs of summaries with vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.functions.text import strip_ws


def latest_by_key(df: DataFrame, key: str, seq: str, then: list[str] = ()) -> DataFrame:
    """Last record per key by ``seq``, equal ones by the ``then`` columns: a
    partial aggregation, each task keeps one record per key before the exchange.
    (The record is a struct with texts, so Spark sorts the rows of a task by key
    to aggregate them.) A record without ``seq`` comes before all with one."""
    others = [c for c in df.columns if c != key]
    lowest = F.struct(F.col(seq).isNotNull().alias("has"), F.col(seq).alias("seq"), *[F.col(c) for c in then])
    return (df.groupBy(key).agg(F.max_by(F.struct(*others), lowest).alias("_r"))
            .select(key, "_r.*"))


def non_blank(df: DataFrame, text: str = "summary") -> DataFrame:
    return df.where(F.length(strip_ws(text)) > 0)


def pending(sample: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of the sample with no finished record yet (left anti join)."""
    return sample.join(done.select(key).distinct(), on=key, how="left_anti")


def attach_vectors(journal: DataFrame, vectors: DataFrame, key: str = "row_idx") -> DataFrame:
    """Journal left-joined to vectors; a record without a vector keeps a null
    vector (count them with :func:`missing_vectors`)."""
    return journal.join(vectors, on=key, how="left")


def missing_vectors(pairs: DataFrame, vec: str) -> DataFrame:
    return pairs.agg(F.count(F.lit(1)).alias("n"),
                     F.sum(F.when(F.col(vec).isNull(), 1).otherwise(0)).alias("n_missing_vector"))


def overlap_count(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of ``a`` whose key also appears in ``b`` (train / holdout guard)."""
    return a.join(b.select(key).distinct(), on=key, how="left_semi").agg(
        F.count(F.lit(1)).alias("n_overlap"))
