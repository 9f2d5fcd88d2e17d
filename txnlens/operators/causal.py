"""Causal per-card features (velocity 1h / 24h, amount z-score, card tenure).

For each row, only rows of the same card that come EARLIER in processing order
``(ts_sec, id)`` count:

* ``velocity_1h`` / ``velocity_24h``: earlier rows with ``t - s <= 3600`` /
  ``<= 86400`` (inclusive edge; an earlier row with the same second counts).
* ``amt_zscore``: ``(a - mean) / (population std + 1e-6)`` over the earlier
  amounts, 0.0 when fewer than two earlier rows exist.
* ``card_tenure_days``: ``(t - first t of the card) / 86400``.

A row with a null card, or without a time, has no place in any history: all
four features are zero, and no other row sees it.

Two physical strategies compute the same table:

* ``window``: one ``Window.partitionBy(card)`` pass. Only growing frames are
  used, so the work per card is linear. Every row of a card lands in one task,
  so this is only chosen when the largest card is known to be small.
* ``skew``: hot cards are split. Rows are range-partitioned on
  ``(card, time, kind, id)``; each partition computes running aggregates per
  card fragment; the history that precedes a fragment in earlier partitions is
  folded into a carry table with at most one row per range partition (a proven
  bound), which is broadcast. Velocity needs "number of card rows with
  ``ts <= t - 3601``", which is answered by probe rows sorted into the same
  order, so no sliding frame and no pairwise comparison is ever needed.

``strategy="auto"`` measures the largest card with one cheap aggregate and
picks ``window`` below ``max_card_rows``, else ``skew``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnlens.operators.ordering import shared_exchange

# Fixed values that must equal the reference: window edges in seconds, the
# z-score epsilon, seconds per day.
HOUR_SECONDS = 3600
DAY_SECONDS = 86400
Z_EPS = 1e-6

FEATURE_COLS = ["velocity_1h", "velocity_24h", "amt_zscore", "card_tenure_days"]

# Rows of one card that one task may hold in the single-window strategy.
DEFAULT_MAX_CARD_ROWS = 2_000_000


def group_size_stats(df: DataFrame, key: str) -> tuple[int, int]:
    """(rows in the largest non-null group, rows with a non-null key): one
    partial aggregate per key, then a max and a sum."""
    r = (df.where(F.col(key).isNotNull()).groupBy(key).count()
         .agg(F.max("count").alias("m"), F.sum("count").alias("t")).first())
    return int(r["m"] or 0), int(r["t"] or 0)


def largest_group_rows(df: DataFrame, key: str) -> int:
    """Rows in the largest non-null group."""
    return group_size_stats(df, key)[0]


def causal_features(df: DataFrame, card: str = "card_id", ts: str = "ts_sec",
                    amount: str = "amt", key: str = "txn_id", strategy: str = "auto",
                    max_card_rows: int = DEFAULT_MAX_CARD_ROWS,
                    num_partitions: int | None = None) -> DataFrame:
    """Add the four causal features to ``df`` (``key`` must be unique)."""
    if strategy == "auto" or (strategy == "skew" and num_partitions is None):
        largest, rows = group_size_stats(df, card)
        if strategy == "auto":
            strategy = "window" if largest <= max_card_rows else "skew"
        if num_partitions is None:
            # the skew path ranges 3 narrow rows (row + 2 probes) per input row
            from txnlens.operators.ordering import partitions_for
            num_partitions = partitions_for(df.sparkSession, 3 * rows)
    if strategy == "window":
        return _by_window(df, card, ts, amount, key)
    if strategy == "skew":
        feats = causal_feature_table(df, card, ts, amount, key, num_partitions)
        return df.join(feats, on=key, how="left")
    raise ValueError(f"unknown strategy {strategy!r}")


def _zscore(a: Column, n: Column, mean: Column, m2: Column) -> Column:
    std = F.sqrt(F.greatest(m2, F.lit(0.0)) / n)
    return F.when(n >= 2, (a - mean) / (std + F.lit(Z_EPS))).otherwise(F.lit(0.0))


def _by_window(df: DataFrame, card: str, ts: str, amount: str, key: str) -> DataFrame:
    c, t, a = F.col(card), F.col(ts), F.col(amount).cast("double")
    # A null card is routed to a group of its own (keyed by the row id) so it
    # sees no history, instead of pooling every null into one group. The
    # segment key is one column, so every window below shares one
    # partitioning: one exchange and one sort for all of them.
    x = df.withColumn("_nk", F.when(c.isNull() | t.isNull(), F.col(key)))
    seg = [c, F.col("_nk")]
    ordered = Window.partitionBy(*seg).orderBy(t, F.col(key))
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    by_time = Window.partitionBy(*seg).orderBy(t)
    earlier = F.row_number().over(ordered) - 1
    older_1h = F.count(F.lit(1)).over(
        by_time.rangeBetween(Window.unboundedPreceding, -(HOUR_SECONDS + 1)))
    older_24h = F.count(F.lit(1)).over(
        by_time.rangeBetween(Window.unboundedPreceding, -(DAY_SECONDS + 1)))
    n = F.count(a).over(before)
    mean = F.avg(a).over(before)
    m2 = F.var_pop(a).over(before) * n
    first = F.min(t).over(Window.partitionBy(*seg))
    timed = lambda x, zero: F.when(t.isNotNull(), x).otherwise(F.lit(zero))
    return (x.select("*", timed((earlier - older_1h).cast("bigint"), 0).cast("bigint").alias("velocity_1h"),
                     timed((earlier - older_24h).cast("bigint"), 0).cast("bigint").alias("velocity_24h"),
                     timed(_zscore(a, n, mean, m2), 0.0).alias("amt_zscore"),
                     timed((t - first) / F.lit(float(DAY_SECONDS)), 0.0).alias("card_tenure_days"))
            .drop("_nk"))


def causal_feature_table(df: DataFrame, card: str = "card_id", ts: str = "ts_sec",
                         amount: str = "amt", key: str = "txn_id",
                         num_partitions: int | None = None) -> DataFrame:
    """Skew-safe feature table ``(key, velocity_1h, velocity_24h, amt_zscore,
    card_tenure_days)``; a hot card is spread over many range partitions."""
    spark = df.sparkSession
    n_parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = df.select(F.col(card).alias("_c"), F.col(ts).cast("bigint").alias("_t"),
                     F.col(key).alias("_k"), F.col(amount).cast("double").alias("_a"))

    placeless = F.col("_c").isNull() | F.col("_t").isNull()
    nulls = (base.where(placeless)
             .select(F.col("_k"), F.lit(0).cast("bigint").alias("velocity_1h"),
                     F.lit(0).cast("bigint").alias("velocity_24h"),
                     F.lit(0.0).alias("amt_zscore"), F.lit(0.0).alias("card_tenure_days")))

    # kind 0 = the row itself at its time; kinds 1 / 2 = probes at t-3601 and
    # t-86401. Data sorts before probes at equal time, so the running count of
    # data rows seen at a probe is "card rows with ts <= probe time".
    none = F.lit(None).cast("double")
    ev = (base.where(~placeless)
          .select("_c", "_k", F.explode(F.array(
              F.struct(F.col("_t").alias("_x"), F.lit(0).alias("_kind"), F.col("_a").alias("_a")),
              F.struct((F.col("_t") - (HOUR_SECONDS + 1)).alias("_x"), F.lit(1).alias("_kind"),
                       none.alias("_a")),
              F.struct((F.col("_t") - (DAY_SECONDS + 1)).alias("_x"), F.lit(2).alias("_kind"),
                       none.alias("_a")))).alias("e"))
          .select("_c", "_k", "e._x", "e._kind", "e._a"))
    # one range exchange read by the fragment windows and the carry table
    ev = shared_exchange(ev.repartitionByRange(n_parts, "_c", "_x", "_kind", "_k")
                         .withColumn("_p", F.spark_partition_id()))

    is_data = F.col("_kind") == 0
    data_x = F.when(is_data, F.col("_x"))

    # Per (range partition, card) fragment: running aggregates inside it.
    frag = Window.partitionBy("_p", "_c").orderBy("_x", "_kind", "_k")
    prev = frag.rowsBetween(Window.unboundedPreceding, -1)
    local = ev.select(
        "_p", "_c", "_k", "_kind", "_x", "_a",
        F.count(data_x).over(prev).alias("_cnt_l"),
        F.count("_a").over(prev).alias("_n_l"),
        F.avg("_a").over(prev).alias("_mean_l"),
        (F.var_pop("_a").over(prev) * F.count("_a").over(prev)).alias("_m2_l"),
        F.min(data_x).over(Window.partitionBy("_p", "_c")).alias("_first_l"))

    # Last fragment of each partition, and its first card: <= 1 row per partition.
    frags = ev.groupBy("_p", "_c").agg(
        F.count(data_x).alias("n"), F.count("_a").alias("na"),
        F.avg("_a").alias("mean"), (F.var_pop("_a") * F.count("_a")).alias("m2"),
        F.min(data_x).alias("first"))
    bounds = frags.groupBy("_p").agg(
        F.min("_c").alias("first_c"), F.max("_c").alias("last_c"),
        F.max_by(F.struct("n", "na", "mean", "m2", "first"), "_c").alias("last"))
    # Running totals over the partitions that end with the same card. A
    # partition's carry is the running total of the partition just before it,
    # when that one ends with the partition's first card. Moments are taken
    # about the card's first fragment mean, not about zero: the squares then
    # measure the spread of the amounts, and a constant or nearly constant
    # history loses nothing to cancellation.
    run = Window.partitionBy("last_c").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    ref = F.first(F.col("last.mean"), ignorenulls=True).over(
        Window.partitionBy("last_c").orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    bounds = bounds.withColumn("ref", ref)
    off = F.coalesce(F.col("last.mean") - F.col("ref"), F.lit(0.0))
    q = F.coalesce(F.col("last.m2"), F.lit(0.0)) + F.col("last.na") * off * off
    cum = bounds.select(
        "_p", "first_c", "last_c",
        F.sum("last.n").over(run).alias("cn"), F.sum("last.na").over(run).alias("cna"),
        F.sum(F.col("last.na") * off).over(run).alias("cs"), "ref",
        F.sum(q).over(run).alias("cq"), F.min("last.first").over(run).alias("cfirst"))
    # Bounded by the partition count, so a global order here is cheap.
    prev_p = Window.orderBy("_p")
    carry = (cum.select(
        "_p", "first_c",
        F.lag(F.struct("last_c", "cn", "cna", "cs", "cq", "ref", "cfirst")).over(prev_p).alias("pv"))
        .where(F.col("pv.last_c") == F.col("first_c"))
        .select("_p", F.col("first_c").alias("_c"), F.col("pv.cn").alias("_cn"),
                F.col("pv.cna").alias("_cna"), F.col("pv.cs").alias("_cs"),
                F.col("pv.cq").alias("_cq"), F.coalesce("pv.ref", F.lit(0.0)).alias("_ref"),
                F.col("pv.cfirst").alias("_cfirst")))

    j = local.join(F.broadcast(carry), on=["_p", "_c"], how="left")
    cn = F.coalesce(F.col("_cn"), F.lit(0))
    cna = F.coalesce(F.col("_cna"), F.lit(0)).cast("double")
    # everything below is relative to the carry's reference value
    cs, at = F.coalesce(F.col("_cs"), F.lit(0.0)), F.coalesce(F.col("_ref"), F.lit(0.0))
    c_mean = F.try_divide(cs, cna)
    c_m2 = F.greatest(F.coalesce(F.col("_cq"), F.lit(0.0)) - F.try_divide(cs * cs, cna), F.lit(0.0))
    nl = F.col("_n_l").cast("double")
    ml = F.coalesce(F.col("_mean_l") - at, F.lit(0.0))
    m2l = F.coalesce(F.col("_m2_l"), F.lit(0.0))
    n_all = nl + cna
    mean_all = F.when(cna == 0, ml).when(nl == 0, c_mean).otherwise(F.try_divide(nl * ml + cs, n_all))
    m2_all = (F.when(cna == 0, m2l).when(nl == 0, c_m2)
              .otherwise(m2l + c_m2 + F.try_divide(nl * cna, n_all) * (ml - c_mean) * (ml - c_mean)))
    seen = F.col("_cnt_l") + cn
    first = F.least(F.col("_cfirst"), F.col("_first_l"))

    per = j.select(
        "_k", "_kind", seen.alias("seen"),
        F.when(is_data, _zscore(F.col("_a") - at, n_all, mean_all, m2_all)).alias("z"),
        F.when(is_data, (F.col("_x") - first) / F.lit(float(DAY_SECONDS))).alias("ten"))
    feats = per.groupBy("_k").agg(
        F.max(F.when(is_data, F.col("seen"))).alias("_rn"),
        F.max(F.when(F.col("_kind") == 1, F.col("seen"))).alias("_o1"),
        F.max(F.when(F.col("_kind") == 2, F.col("seen"))).alias("_o24"),
        F.max("z").alias("amt_zscore"), F.max("ten").alias("card_tenure_days"))
    feats = feats.select(
        "_k", (F.col("_rn") - F.col("_o1")).cast("bigint").alias("velocity_1h"),
        (F.col("_rn") - F.col("_o24")).cast("bigint").alias("velocity_24h"),
        "amt_zscore", "card_tenure_days")
    return feats.unionByName(nulls).withColumnRenamed("_k", key)
