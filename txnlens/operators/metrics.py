"""Evaluation metrics as aggregations.

Everything is one or two passes of partial aggregation; exact order
statistics use the distributed global rank (never a single-task sort), and
AUC / AP use prefix sums over the distinct scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlens.functions import vectors as V
from txnlens.operators.ordering import prefix_sums, rank_table


def vector_dim(df: DataFrame, vec: str) -> int:
    """Array length of the first row (vectors of one column share a size)."""
    r = df.select(F.size(vec).alias("d")).where(F.col("d") > 0).first()
    if r is None:
        raise ValueError(f"no non-empty vectors in {vec!r}")
    return int(r["d"])


# Up to this many dimensions an element-wise mean is one aggregate with d
# columns; wider vectors go through posexplode + groupBy(position).
WIDE_AGG_MAX_DIM = 512


def vector_mean(df: DataFrame, vec: str, by: list[str] = (), dim: int | None = None,
                out: str = "mean_vector") -> DataFrame:
    """Element-wise mean per group: one aggregate with ``d`` partial sums (no
    explode) for moderate d; a positional explode for very wide vectors."""
    d = dim or vector_dim(df, vec)
    v = V.as_double(vec)
    if d > WIDE_AGG_MAX_DIM:
        e = df.select(*by, F.posexplode(v).alias("_i", "_x"))
        m = e.groupBy(*by, "_i").agg(F.avg("_x").alias("_m"))
        arr = m.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_s"))
        n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
        j = null_safe_join(arr, n, list(by)) if by else merge_rows(arr, n)
        return j.select(*by, "n", F.transform("_s", lambda x: x["_m"]).alias(out))
    g = df.groupBy(*by).agg(*[F.avg(F.element_at(v, i + 1)).alias(f"_m{i}") for i in range(d)],
                            F.count(F.lit(1)).alias("n"))
    return g.select(*by, "n", F.array(*[F.col(f"_m{i}") for i in range(d)]).alias(out))


def null_safe_join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which a null key meets a null key, as grouping has it."""
    named = b.select(*[F.col(c).alias(f"_k_{c}") if c in keys else F.col(c) for c in b.columns])
    on = None
    for c in keys:
        cond = F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        on = cond if on is None else on & cond
    return a.join(named, on).drop(*[f"_k_{c}" for c in keys])


def mse_nrm(df: DataFrame, pred: str, gold: str, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(V.row_mse_nrm(pred, gold)).alias("mse_nrm"),
                               F.count(F.lit(1)).alias("n"))


def fve(df: DataFrame, pred: str, gold: str, by: list[str] = (), dim: int | None = None,
        min_rows: int = 0, rollup: bool = False, wide_dim: int | None = None) -> DataFrame:
    """Fraction of variance explained on metric-normalised vectors, per group.

    ``den = mean_rows |g|^2 / d - |mu|^2 / d`` with ``mu`` the (not
    re-normalised) mean of the normalised gold vectors, so ONE aggregation
    pass gives n, MSE and FVE (the d means are partial sums in the same
    aggregate). ``rollup`` adds the overall line (group keys null) from the
    same pass. Beyond ``wide_dim`` dimensions the means are taken per position
    instead; the rows are the same. A zero denominator, or a group with ``n <= min_rows``, gives
    null."""
    d = dim or vector_dim(df, gold)
    gn = V.normalize_to(gold)
    x = df.select(*by, V.row_mse_nrm(pred, gold).alias("_mse"), gn.alias("_g"))
    base = [F.count(F.lit(1)).alias("n"), F.avg("_mse").alias("mse_nrm"),
            F.avg(V.vec_sum(F.transform("_g", lambda t: t * t))).alias("_g2")]
    grouped = x.rollup(*by) if rollup else x.groupBy(*by)
    if d <= (WIDE_AGG_MAX_DIM if wide_dim is None else wide_dim):
        g = grouped.agg(*base, *[F.avg(F.element_at("_g", i + 1)).alias(f"_mu{i}") for i in range(d)])
        mu2 = sum((F.col(f"_mu{i}") * F.col(f"_mu{i}") for i in range(d)), F.lit(0.0))
    else:
        # per position, with the same grouping sets
        sets = [list(by)[:k] for k in range(len(by), -1, -1)] if rollup else [list(by)]
        e = x.select(*by, F.posexplode("_g").alias("_i", "_x"))
        squares = []
        for k, keys in enumerate(sets):
            m = e.groupBy(*keys, "_i").agg(F.avg("_x").alias("_m")).groupBy(*keys).agg(F.sum(F.col("_m") * F.col("_m")).alias("_mu2"))
            own = x.groupBy(*keys).agg(*base)
            one = null_safe_join(own, m, keys) if keys else merge_rows(own, m)
            squares.append(one.select(*[(F.col(c) if c in keys else F.lit(None).cast(df.schema[c].dataType)).alias(c) for c in by], "n", "mse_nrm", "_g2", "_mu2"))
        g = squares[0]
        for one in squares[1:]:
            g = g.unionByName(one)
        mu2 = F.col("_mu2")
    den = (F.col("_g2") - mu2) / F.lit(float(d))
    ok = (den != 0) & (F.col("n") > min_rows)
    return g.select(*by, "n", "mse_nrm",
                    F.when(ok, F.lit(1.0) - F.col("mse_nrm") / den).alias("fve_nrm"))


def exact_quantiles(df: DataFrame, value: str, qs: dict[str, float],
                    lower: dict[str, float] | None = None, by: list[str] = (),
                    key: str | None = None, moments: bool = False) -> DataFrame:
    """Exact order statistics per group, computed from the distributed rank.

    ``qs``: name -> q with linear interpolation at ``q * (n - 1)`` (numpy /
    torch default). ``lower``: name -> q taking the value at
    ``floor(q * (n - 1))`` (torch ``median`` is the lower middle).
    ``moments`` adds ``n``, ``mean`` and population ``std`` computed from the
    same ranked rows (no second pass over the input). A null group or key is
    kept; rows without a value are left out."""
    lower = lower or {}
    # Only the values at given positions are needed and tied values are equal,
    # so the order need not be total: rank the order columns themselves (no
    # nondeterministic tie-breaker, no join back to the rows).
    order = list(by) + [value] + ([key] if key else [])
    base = df.select(*order).where(F.col(value).isNotNull())
    mom = [F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"),
           F.stddev_pop(value).alias("std")] if moments else []
    if by:
        r = rank_table(base, order, rank_col="_g", nullable=[*by, *([key] if key else [])])
        start = r.groupBy(*by).agg(F.min("_g").alias("_s"), F.count(F.lit(1)).alias("_n"), *mom)
        r = null_safe_join(r, start, list(by))
    else:
        r = rank_table(base, order, rank_col="_g", total_col="_n", nullable=[key] if key else []).withColumn("_s", F.lit(0))
        extra = r.agg(*mom) if moments else None
    r = r.withColumn("_i", F.col("_g") - F.col("_s"))
    pos = {}
    for name, q in qs.items():
        p = F.lit(q) * (F.col("_n") - 1)
        pos[name] = (F.floor(p), F.ceil(p), p - F.floor(p))
    for name, q in lower.items():
        p = F.floor(F.lit(q) * (F.col("_n") - 1))
        pos[name] = (p, p, F.lit(0.0))
    aggs = []
    for name, (lo, hi, frac) in pos.items():
        v_lo = F.max(F.when(F.col("_i") == lo, F.col(value)))
        v_hi = F.max(F.when(F.col("_i") == hi, F.col(value)))
        aggs += [v_lo.alias(f"_lo_{name}"), v_hi.alias(f"_hi_{name}"),
                 F.max(frac).alias(f"_f_{name}")]
    if moments and by:
        aggs += [F.first(c).alias(c) for c in ("n", "mean", "std")]
    # Only the rows at the needed positions survive the filter, so the final
    # aggregate sees at most 2 * len(qs) rows per group.
    need = None
    for lo, hi, _ in pos.values():
        c = (F.col("_i") == lo) | (F.col("_i") == hi)
        need = c if need is None else need | c
    g = r.where(need).groupBy(*by).agg(*aggs)
    outs = [F.col(f"_lo_{n}") + F.col(f"_f_{n}") * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))
            for n in pos]
    res = g.select(*by, *[o.alias(n) for o, n in zip(outs, pos)],
                   *(["n", "mean", "std"] if moments and by else []))
    if moments and not by:
        res = merge_rows(res, extra)
    return res


def merge_rows(a: DataFrame, b: DataFrame, by: list[str] = ()) -> DataFrame:
    """Put two per-group summaries side by side: a join on the group keys, or
    for one-row summaries a union + aggregate (no cartesian product)."""
    if by:
        return a.join(b, on=list(by), how="inner")
    cols = list(dict.fromkeys(a.columns + b.columns))
    u = a.unionByName(b, allowMissingColumns=True)
    return u.agg(*[F.max(c).alias(c) for c in cols])


def cosine_summary(df: DataFrame, pred: str, gold: str, by: list[str] = (),
                   key: str | None = None) -> DataFrame:
    """mean, lower median, p10, p90 of per-row cosine (one ranked pass)."""
    c = df.select(*by, *([key] if key else []), V.cosine(pred, gold).alias("cos"))
    q = exact_quantiles(c, "cos", {"cos_p10": 0.1, "cos_p90": 0.9},
                        lower={"cos_median": 0.5}, by=list(by), key=key, moments=True)
    return q.withColumnRenamed("mean", "cos_mean").drop("std")


def distribution_block(df: DataFrame, value: str, by: list[str] = (),
                       key: str | None = None) -> DataFrame:
    """mean, interpolated median, p5, p95, population std, n (one ranked pass)."""
    return exact_quantiles(df, value, {"median": 0.5, "p5": 0.05, "p95": 0.95}, by=list(by),
                           key=key, moments=True)


def _score_hist(df: DataFrame, score: str, label: str, weight: str | None) -> DataFrame:
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(0.0)).alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0.0).otherwise(w)).alias("neg"))


def auc_ap(df: DataFrame, score: str, label: str, weight: str | None = None) -> DataFrame:
    """AUC-ROC (ties counted half) and step-wise average precision from ONE
    prefix-sum pass over the distinct scores (ascending): counts at or above a
    threshold are the totals minus the counts below it.

    AUC = sum_s pos(s) (neg below s + neg(s) / 2) / (P N)
    AP  = sum_s pos(s) TP(s) / (TP(s) + FP(s)) / P, TP / FP at score >= s
    (not the trapezoid MLlib reports). AP ignores weights. A null score is below
    every other: such a row is counted and found last."""
    df = df.withColumn(score, F.coalesce(F.col(score).cast("double"), F.lit(float("-inf"))))
    h = prefix_sums(_score_hist(df, score, label, weight), ["s"], ["pos", "neg"], totals=True)
    below_neg = F.col("cum_neg") - F.col("neg")
    tp = F.col("tot_pos") - F.col("cum_pos") + F.col("pos")
    fp = F.col("tot_neg") - F.col("cum_neg") + F.col("neg")
    t = h.agg(F.sum(F.col("pos") * (below_neg + F.lit(0.5) * F.col("neg"))).alias("u"),
              F.sum(F.when(F.col("pos") > 0, F.col("pos") * tp / (tp + fp))).alias("ap_u"),
              F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    return t.select(F.when((F.col("p") > 0) & (F.col("q") > 0),
                           F.col("u") / (F.col("p") * F.col("q"))).alias("auc_roc"),
                    F.when(F.col("p") > 0, F.coalesce(F.col("ap_u"), F.lit(0.0)) / F.col("p"))
                    .alias("average_precision"),
                    F.col("p").alias("n_pos"), F.col("q").alias("n_neg"))


def auc_roc(df: DataFrame, score: str, label: str, weight: str | None = None) -> DataFrame:
    """Area under ROC with tied scores counted half."""
    return auc_ap(df, score, label, weight).select("auc_roc", "n_pos", "n_neg")


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """Step-wise AP ``sum (R_n - R_(n-1)) P_n`` over distinct thresholds."""
    return auc_ap(df, score, label).select("average_precision")


def weighted_mean(df: DataFrame, value: str, weight: str, by: list[str] = ()) -> DataFrame:
    w = F.col(weight).cast("double")
    return df.groupBy(*by).agg(
        (F.sum(w * F.col(value)) / F.sum(w)).alias(f"wmean_{value}"),
        F.avg(value).alias(f"mean_{value}"), F.count(F.lit(1)).alias("n"))


def masked_stats(n_col: Column, value: Column, threshold: int) -> Column:
    """A slice statistic reported only when the slice has more than
    ``threshold`` rows."""
    return F.when(n_col > threshold, value)
