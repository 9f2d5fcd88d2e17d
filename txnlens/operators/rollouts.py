"""Rollout tables from policy training: group-normalised advantages, the
completion mask, per-token KL and the per-step report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.functions import vectors as V

# Fixed value that must equal the reference.
ADV_EPS = 1e-4


def group_advantage(df: DataFrame, group: str, reward: str, out: str = "advantage") -> DataFrame:
    """``(r - mean_g) / (sample std_g + 1e-4)``; a group of one has no sample
    std and gets null. Group statistics are a partial aggregation joined back
    on the group key, so even a very large group is never one task (AQE can
    split a hot key in the join)."""
    stats = df.groupBy(group).agg(F.avg(reward).alias("_gm"), F.stddev_samp(reward).alias("_gs"))
    return (df.join(stats, group, "left")
            .withColumn(out, F.when(F.col("_gs").isNotNull(),
                                    (F.col(reward) - F.col("_gm")) / (F.col("_gs") + F.lit(ADV_EPS))))
            .drop("_gm", "_gs"))


def with_token_stats(df: DataFrame, ids: str, logp_policy: str, logp_ref: str, eos: int) -> DataFrame:
    """Completion mask, completion length and masked mean KL per rollout."""
    mask = V.completion_mask(ids, eos)
    return (df.withColumn("mask", mask)
            .withColumn("completion_len", F.aggregate("mask", F.lit(0), lambda a, m: a + m))
            .withColumn("kl", V.masked_mean(V.kl_k3(logp_policy, logp_ref), F.col("mask"))))


def step_report(df: DataFrame, step: str = "step") -> DataFrame:
    """Per step: mean reward, mean mse (= -reward), mean completion length,
    mean KL, number of rollouts."""
    return df.groupBy(step).agg(
        F.avg("reward").alias("mean_reward"), F.avg(-F.col("reward")).alias("mean_mse"),
        F.avg("completion_len").alias("mean_completion_len"), F.avg("kl").alias("mean_kl"),
        F.count(F.lit(1)).alias("n"))
