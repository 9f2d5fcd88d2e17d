"""Per-split class balance and small scalar aggregates over labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_balance(df: DataFrame, split: str = "train_split", label: str = "is_fraud",
                  extra=()) -> DataFrame:
    """``(split, n, n_fraud, pct_fraud, *extra)``; ``pct_fraud`` is null for
    an empty split instead of a division error. ``extra`` aggregates are
    computed in the same pass."""
    g = df.groupBy(split).agg(F.count(F.lit(1)).alias("n"),
                              F.sum(F.col(label).cast("bigint")).alias("n_fraud"), *extra)
    return g.withColumn("pct_fraud", F.when(F.col("n") > 0,
                                            F.lit(100.0) * F.col("n_fraud") / F.col("n")))


def positive_weight(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """``n_neg / max(1, n_pos)`` as a one-row table (class weight for training)."""
    return df.agg(
        F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("n_neg"),
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("n_pos")
    ).withColumn("pos_weight", F.col("n_neg") / F.greatest(F.lit(1), F.col("n_pos")))
