"""Validity controls for vector -> text -> vector round trips.

* real: reconstruction of row i from its own text, graded against h_i;
* swap: reconstruction from the text of a deranged partner j, graded against
  h_i (not h_j);
* floor: the mean unit vector predicted for every row (scored through the
  same normalisation, so it does not score 0).

The verdict: PASS if ``swap - floor <= 0.05`` and ``real - swap >= 0.15``;
FAIL if ``real - swap < 0.05``; else AMBIGUOUS. Below the floor is a pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlens.functions import text as X
from txnlens.functions import vectors as V
from txnlens.operators import metrics as M
from txnlens.operators.sampling import derange
from txnlens.session import cut_lineage

# Fixed values that must equal the reference.
PASS_FLOOR_GAP = 0.05
PASS_REAL_GAP = 0.15
FAIL_REAL_GAP = 0.05
FLOOR_EPS = 1e-12


def verdict(real_fve: Column, swap_fve: Column, floor_fve: Column) -> Column:
    gap_rs = real_fve - swap_fve
    gap_sf = swap_fve - floor_fve
    return (F.when((gap_sf <= PASS_FLOOR_GAP) & (gap_rs >= PASS_REAL_GAP), F.lit("PASS"))
            .when(gap_rs < FAIL_REAL_GAP, F.lit("FAIL")).otherwise(F.lit("AMBIGUOUS")))


def mean_unit_vector(df: DataFrame, gold: str, dim: int | None = None) -> list[float]:
    """Mean of ``x / max(|x|, 1e-12)``: d numbers (a proven size bound)."""
    u = df.select(V.let(F.greatest(V.vec_norm(gold), F.lit(FLOOR_EPS)),
                        lambda n: F.transform(gold, lambda x: x.cast("double") / n)).alias("_u"))
    return [float(x) for x in M.vector_mean(u, "_u", dim=dim).first()["mean_vector"]]


def swap_pairs(df: DataFrame, key: str, gold: str, pred: str, text: str | None,
               seed: int) -> DataFrame:
    """One row per key: own gold and prediction, the deranged partner's
    prediction, and (with texts) the token Jaccard of the two texts."""
    pairs = derange(df, key, seed, partner="_partner")
    partner = df.select(F.col(key).alias("_partner"), F.col(pred).alias("_ppred"),
                        *([F.col(text).alias("_ptext")] if text else []))
    sw = df.join(pairs.select(key, "_partner"), key).join(partner, "_partner")
    cols = [key, gold, pred, "_ppred"]
    if text:
        cols.append(X.token_jaccard(text, "_ptext").alias("jaccard"))
    return sw.select(*cols)


def swap_table(df: DataFrame, key: str, gold: str, pred: str, text: str | None,
               seed: int, dim: int | None = None):
    """(long table ``(condition, key, gold, pred)`` for the real, swap and
    floor conditions, per-key Jaccard or None). The partner join runs once and
    is checkpointed (narrow: vectors and one number), both outputs read it."""
    sw = cut_lineage(swap_pairs(df, key, gold, pred, text, seed))
    mu_col = F.array(*[F.lit(x) for x in mean_unit_vector(df, gold, dim)])
    keep = [key, gold]
    long = (sw.select(F.lit("real").alias("condition"), *keep, F.col(pred).alias("pred"))
            .unionByName(sw.select(F.lit("swap").alias("condition"), *keep,
                                   F.col("_ppred").alias("pred")))
            .unionByName(sw.select(F.lit("floor").alias("condition"), *keep,
                                   mu_col.alias("pred"))))
    jac = sw.select(key, "jaccard") if text else None
    return long, jac


def condition_metrics(long: DataFrame, key: str, gold: str, dim: int | None = None) -> DataFrame:
    """Per condition: n, fve_nrm, mse_nrm, cos mean, cos (lower) median."""
    f = M.fve(long, "pred", gold, by=["condition"], dim=dim)
    c = M.cosine_summary(long, "pred", gold, by=["condition"], key=key)
    return f.join(c.drop("n"), "condition").select(
        "condition", "n", "fve_nrm", "mse_nrm", "cos_mean", "cos_median")


def swap_control(df: DataFrame, key: str, gold: str, pred: str, text: str | None = None,
                 seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(per-condition metrics, one-row verdict with gaps and text Jaccard)."""
    dim = M.vector_dim(df, gold)
    long, jac = swap_table(df, key, gold, pred, text, seed, dim)
    per = condition_metrics(long, key, gold, dim)
    wide = per.groupBy().pivot("condition", ["real", "swap", "floor"]).agg(F.first("fve_nrm"))
    v = wide.select(
        F.col("real").alias("real_fve"), F.col("swap").alias("swap_fve"),
        F.col("floor").alias("floor_fve"),
        (F.col("real") - F.col("swap")).alias("gap_real_minus_swap_fve"),
        (F.col("swap") - F.col("floor")).alias("gap_swap_minus_floor_fve"),
        verdict(F.col("real"), F.col("swap"), F.col("floor")).alias("verdict"))
    if jac is not None:
        js = M.merge_rows(jac.agg(F.avg("jaccard").alias("jaccard_mean")),
                          M.exact_quantiles(jac, "jaccard", {"jaccard_median": 0.5}, key=key))
        v = M.merge_rows(v, js)
    return per, v


def roundtrip_report(df: DataFrame, key: str, gold: str, pred: str, label: str,
                     raw_text: str, parsed_text: str, min_slice: int = 10) -> DataFrame:
    """One row: n, fve, mse, cosine summary, fraud-slice FVE (only when the
    slice has more than ``min_slice`` rows), n_fraud, text stats."""
    f = M.fve(df, pred, gold)
    c = M.cosine_summary(df, pred, gold, key=key).drop("n")
    fr = M.fve(df.where(F.col(label) == 1), pred, gold, min_rows=min_slice).select(
        F.col("fve_nrm").alias("fve_fraud_slice"))
    t = df.agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("n_fraud"),
               F.avg(F.length(parsed_text)).alias("mean_explanation_chars"),
               (F.lit(100.0) * F.avg(F.when(X.has_close_tag(raw_text), 0.0).otherwise(1.0)))
               .alias("pct_missing_close_tag"))
    out = M.merge_rows(M.merge_rows(f, c), t)
    # A slice with no rows has no aggregate row: union keeps the report whole.
    return M.merge_rows(out, fr)
