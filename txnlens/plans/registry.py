"""Named queries over the test tables: each takes ``(spark, sf_dir)`` and
returns a DataFrame whose columns match the DuckDB oracle of the same name.
Doubles are rounded to 6 places and counts are BIGINT on both sides."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlens.functions.scalar import clip
from txnlens.functions import render as R
from txnlens.functions import scalar as S
from txnlens.functions import text as X
from txnlens.functions import vectors as V
from txnlens.operators import controls as C
from txnlens.operators import evals as EV
from txnlens.operators import geometry as G
from txnlens.operators import journal as J
from txnlens.operators import metrics as M
from txnlens.operators import models as MD
from txnlens.operators import network as NW
from txnlens.operators import pair_order as PO
from txnlens.operators import preprocess as P
from txnlens.operators import probes as PB
from txnlens.operators import rollouts as RO
from txnlens.operators import sampling as SM
from txnlens.operators.balance import class_balance
from txnlens.operators.causal import causal_features
from txnlens.operators.ordering import partitions_for, time_split
from txnlens.session import cut_lineage, shared_path
from txnlens.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def r6(c) -> F.Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


FEATURE_OUT = ["txn_id", "card_id", "ts_sec", "velocity_1h", "velocity_24h"]


def _feature_cols() -> list:
    # Tenure is an exact quotient (identical doubles on both sides, so it is
    # not rounded: rounding ties would be broken differently by the engines);
    # the z-score comes from running aggregates and is rounded.
    return FEATURE_OUT + [r6("amt_zscore").alias("amt_zscore"), "card_tenure_days"]


@query("causal_features")
def q_causal_features(spark, sf_dir):
    return causal_features(T.txn(spark, sf_dir)).select(*_feature_cols())


@query("causal_features_skew")
def q_causal_features_skew(spark, sf_dir):
    """Same-second ties per card; forced through the skew-safe strategy with 8
    range partitions, so cards split across partitions and their carries are
    exercised even on small tables."""
    return causal_features(T.txn_ties(spark, sf_dir), strategy="skew",
                           num_partitions=8).select(*_feature_cols())


def hot_card_txn(spark, sf_dir) -> DataFrame:
    """Events where one card holds a third of all rows (every third event is
    reassigned to card -1): the hot-key case the skew path exists for."""
    t = T.txn(spark, sf_dir)
    return t.withColumn("card_id", F.when(F.pmod(F.col("txn_id"), F.lit(3)) == 0, F.lit(-1))
                        .otherwise(F.col("card_id")))


@query("causal_features_hot_card")
def q_causal_features_hot_card(spark, sf_dir):
    """One card with a third of the rows, through the skew-safe strategy: the
    hot card is split over range partitions (8 here, so it spans several even
    on small tables) and stitched back by the carry table."""
    return causal_features(hot_card_txn(spark, sf_dir), strategy="skew",
                           num_partitions=8).select(*_feature_cols())


def steady_card_txn(spark, sf_dir) -> DataFrame:
    """The hot card with a steady amount, steps of 2^-10 and rare jumps of 10: sums
    are exact, so any loss in merging its fragments shows."""
    x = F.lit(10002.5) + F.when(F.pmod(F.col("txn_id"), F.lit(7)) == 0, F.lit(2.0 ** -10)).otherwise(F.lit(0.0)) \
        + F.when(F.pmod(F.col("txn_id"), F.lit(97)) == 0, F.lit(10.0)).otherwise(F.lit(0.0))
    return hot_card_txn(spark, sf_dir).withColumn("amt", F.when(F.col("card_id") == -1, x).otherwise(F.lit(25.0)))


@query("causal_features_steady_card")
def q_causal_features_steady_card(spark, sf_dir):
    """Constant and nearly constant histories through both strategies."""
    t = steady_card_txn(spark, sf_dir)
    both = [causal_features(t, strategy=s, num_partitions=8).select(
        F.lit(s).alias("strategy"), "txn_id", "velocity_1h", "velocity_24h",
        F.round("amt_zscore", 2).alias("amt_zscore")) for s in ("window", "skew")]
    return both[0].unionByName(both[1])


@query("time_split")
def q_time_split(spark, sf_dir):
    return time_split(T.txn(spark, sf_dir)).select("txn_id", "ts_sec", "train_split")


def split_report(df: DataFrame) -> DataFrame:
    """Class balance per split plus the mean causal features of each split,
    in one aggregation pass."""
    bal = class_balance(df, "train_split", "is_fraud", extra=[
        r6(F.avg("velocity_1h")).alias("mean_velocity_1h"),
        r6(F.avg("velocity_24h")).alias("mean_velocity_24h"),
        r6(F.avg(clip("amt_zscore", -10.0, 10.0))).alias("mean_amt_zscore_clipped"),
        r6(F.max("card_tenure_days")).alias("max_card_tenure_days")])
    return bal.select("train_split", "n", F.col("n_fraud").cast("bigint").alias("n_fraud"),
                      r6("pct_fraud").alias("pct_fraud"), "mean_velocity_1h",
                      "mean_velocity_24h", "mean_amt_zscore_clipped", "max_card_tenure_days")


@query("split_report")
def q_split_report(spark, sf_dir):
    """Flagship: events -> causal features -> time split -> per-split report."""
    return split_report(time_split(causal_features(T.txn(spark, sf_dir))))


# --- ingest and scalar features ------------------------------------------------


def ecom_features(df: DataFrame) -> DataFrame:
    """Email groups, email match and the source tag on e-commerce rows."""
    return (df.withColumn("p_email_group", S.email_group("P_emaildomain"))
            .withColumn("r_email_group", S.email_group("R_emaildomain"))
            .withColumn("email_match", S.email_match("P_emaildomain", "R_emaildomain"))
            .withColumn("dataset_source", F.lit("ieee-fraud-detection")))


@query("ecom_features")
def q_ecom_features(spark, sf_dir):
    df = ecom_features(T.ecom(spark, sf_dir))
    return df.select("txn_id", "card_id", "ts_sec", F.col("hour_of_day").cast("bigint").alias("hour_of_day"),
                     F.col("day_of_week").cast("bigint").alias("day_of_week"),
                     "TransactionAmt", "p_email_group", "r_email_group", "email_match",
                     "dataset_source", "is_fraud")


@query("offset_timestamps")
def q_offset_timestamps(spark, sf_dir):
    """Reference epoch + offset seconds -> timestamp, hour, Monday-0 weekday."""
    o = T.read_table(spark, sf_dir, "orders")
    ts = S.offset_to_timestamp(F.col("o_orderkey") * 3607)
    return o.select(F.col("o_orderkey").alias("txn_id"), S.epoch_seconds(ts).alias("ts_sec"),
                    S.hour_of_day(ts).cast("bigint").alias("hour_of_day"),
                    S.day_of_week(ts).cast("bigint").alias("day_of_week"))


def card_present_features(df: DataFrame) -> DataFrame:
    return (df.withColumn("geo_distance_km",
                          S.haversine_km("lat", "long", "merch_lat", "merch_long"))
            .withColumn("age_at_txn", S.age_years("ts", "dob")))


@query("card_present_features")
def q_card_present_features(spark, sf_dir):
    df = card_present_features(T.with_geo(causal_features(T.txn(spark, sf_dir))))
    return df.select(
        "txn_id", r6("geo_distance_km").alias("geo_distance_km"), "age_at_txn",
        r6(S.clip_named("amt_zscore")).alias("amt_zscore_clipped"),
        S.clip_named("velocity_1h").alias("velocity_1h_clipped"),
        r6(S.logistic(F.col("amt") / 50.0 - 1.0)).alias("amt_logistic"))


@query("score_bins")
def q_score_bins(spark, sf_dir):
    a = T.act(spark, sf_dir)
    return a.select("row_idx", "fraud_score", "label", S.score_bin("fraud_score").alias("score_bin"),
                    S.cell_key("label", "fraud_score").alias("cell"))


@query("text_checks")
def q_text_checks(spark, sf_dir):
    d = T.read_table(spark, sf_dir, "documents")
    return d.select("doc_id", (F.length(X.strip_ws("text")) > 0).alias("non_blank"),
                    X.starts_with_bullet("text").alias("bullet_ok"),
                    S.is_missing("text").alias("is_missing"), "lang")


# --- rendering ---------------------------------------------------------------------


_CP_CATS = ["misc_net", "grocery_pos", "travel", "kids_pets", "gas_transport"]


def card_present_frame(spark, sf_dir) -> DataFrame:
    """Card-present rows with their features. A few merchants are blanked and
    a few categories mapped onto the category table so every branch runs."""
    df = card_present_features(T.with_geo(causal_features(T.txn(spark, sf_dir))))
    k9 = F.pmod(F.col("txn_id"), F.lit(9))
    cat = F.col("category")
    for i, name in reversed(list(enumerate(_CP_CATS))):
        cat = F.when(k9 == i, F.lit(name)).otherwise(cat)
    return (df.withColumn("merchant", F.when(F.pmod(F.col("txn_id"), F.lit(7)) == 3, F.lit(None))
                          .otherwise(F.col("merchant")))
          .withColumn("category", cat)
          .withColumn("fraud_score", F.pmod(F.col("txn_id") * 37, F.lit(101)) / F.lit(100.0))
          .select("txn_id", "merchant", "category", "amt", "hour_of_day", "day_of_week",
                  "velocity_1h", "velocity_24h", "amt_zscore", "card_tenure_days",
                  "geo_distance_km", "age_at_txn", "fraud_score"))


@query("render_card_present")
def q_render_card_present(spark, sf_dir):
    """Card-present rows rendered as English."""
    df = card_present_frame(spark, sf_dir)
    return df.select("txn_id", R.render(df, "sparkov").alias("rendered"))


def ecom_frame(spark, sf_dir) -> DataFrame:
    e = T.ecom(spark, sf_dir).withColumn("amt", F.col("TransactionAmt"))
    return ecom_features(causal_features(e))


@query("render_ecom")
def q_render_ecom(spark, sf_dir):
    """E-commerce rows (orders joined to their customer) rendered as English."""
    df = ecom_frame(spark, sf_dir)
    return df.select("txn_id", R.render(df, "ieee-fraud-detection").alias("rendered"))


@query("render_by_source")
def q_render_by_source(spark, sf_dir):
    """Both kinds of rows in one table, each rendered by its own source column."""
    parts = [f(spark, sf_dir).withColumn("dataset_source", F.lit(s)) for s, f in
             (("sparkov", card_present_frame), ("ieee-fraud-detection", ecom_frame))]
    df = parts[0].unionByName(parts[1], allowMissingColumns=True)
    return df.select("dataset_source", "txn_id", R.render(df, F.col("dataset_source")).alias("rendered"))


# --- vectors and metrics ----------------------------------------------------------


def _round_vec(c) -> F.Column:
    return F.transform(c, lambda x: F.round(x.cast("double"), 6))


@query("vector_norms")
def q_vector_norms(spark, sf_dir):
    a = T.act(spark, sf_dir)
    return a.select("row_idx", r6(V.vec_norm("activation_vector")).alias("l2_norm"),
                    _round_vec(V.unit_stored("activation_vector")).alias("activation_vector_normed"))


@query("vector_mean")
def q_vector_mean(spark, sf_dir):
    m = M.vector_mean(T.act(spark, sf_dir), "activation_vector", by=["class_id"])
    return m.select("class_id", "n", _round_vec(F.col("mean_vector")).alias("mean_vector"))


@query("fve_by_label")
def q_fve_by_label(spark, sf_dir):
    """FVE / MSE per label slice and overall, from one rollup pass."""
    r = T.recon(spark, sf_dir).withColumn("slice", F.col("label").cast("string"))
    per = M.fve(r, "pred_vector", "activation_vector", by=["slice"], rollup=True)
    return per.select(F.coalesce("slice", F.lit("all")).alias("slice"), "n",
                      r6("mse_nrm").alias("mse_nrm"), r6("fve_nrm").alias("fve_nrm"))


@query("fve_null_slice")
def q_fve_null_slice(spark, sf_dir):
    """FVE with a null slice, per slice and overall, through the one-aggregate path
    and the per-position path of wide vectors: the same rows from both."""
    r = T.recon(spark, sf_dir).withColumn("slice", F.when(F.col("label") == 1, F.lit("1")))
    both = [M.fve(r, "pred_vector", "activation_vector", by=["slice"], rollup=True, wide_dim=d).select(
        F.lit(path).alias("path"), "slice", "n", r6("mse_nrm").alias("mse_nrm"), r6("fve_nrm").alias("fve_nrm"))
        for path, d in (("narrow", M.WIDE_AGG_MAX_DIM), ("wide", 1))]
    return both[0].unionByName(both[1])


@query("cosine_summary")
def q_cosine_summary(spark, sf_dir):
    s = M.cosine_summary(T.recon(spark, sf_dir), "pred_vector", "activation_vector", key="row_idx")
    return s.select("n", *[r6(c).alias(c) for c in ["cos_mean", "cos_median", "cos_p10", "cos_p90"]])


def scored(spark, sf_dir) -> DataFrame:
    d = T.read_table(spark, sf_dir, "documents")
    lab = T.read_table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select("doc_id", F.col("n_chars").cast("double").alias("score"),
                                        F.col("quality").alias("label"), "toxic")


@query("auc_ap")
def q_auc_ap(spark, sf_dir):
    s = scored(spark, sf_dir)
    return M.auc_ap(s, "score", "label").select(r6("auc_roc").alias("auc_roc"),
                                        r6("average_precision").alias("average_precision"),
                                        "n_pos", "n_neg")


# --- sampling ------------------------------------------------------------------


@query("exact_sample")
def q_exact_sample(spark, sf_dir):
    return SM.exact_sample(T.act(spark, sf_dir), "row_idx", 50, seed=7).select(
        "row_idx", "fraud_score", "label")


@query("head_rows")
def q_head_rows(spark, sf_dir):
    d = T.read_table(spark, sf_dir, "documents")
    return SM.head(d, "doc_id", 20).select("doc_id", "lang", "n_chars")


def biased_sample(a: DataFrame) -> DataFrame:
    """Rows that survived a selection biased toward high scores and positives
    (stand-in for the rows whose summaries were generated)."""
    return a.where((F.col("fraud_score") >= 0.5) | (F.col("label") == 1))


@query("importance_weights")
def q_importance_weights(spark, sf_dir):
    a = T.act(spark, sf_dir).withColumn("cell", S.cell_key("label", "fraud_score"))
    w = SM.cell_report(biased_sample(a), a, "cell")
    return w.select("cell", "n_population", "n_sample", r6("weight").alias("weight"))


@query("weighted_metric")
def q_weighted_metric(spark, sf_dir):
    """Per-label mean score of the biased sample, raw and reweighted back to
    the population with the importance weights."""
    a = T.act(spark, sf_dir).withColumn("cell", S.cell_key("label", "fraud_score"))
    smp = biased_sample(a)
    w = SM.importance_weights(smp, a, "cell").select("cell", "weight")
    j = smp.join(F.broadcast(w), "cell")
    m = M.weighted_mean(j, "fraud_score", "weight", by=["label"])
    return m.select("label", "n", r6("wmean_fraud_score").alias("wmean_fraud_score"),
                    r6("mean_fraud_score").alias("mean_fraud_score"))


@query("stratified_sample")
def q_stratified_sample(spark, sf_dir):
    s = SM.stratified_sample(T.act(spark, sf_dir), "row_idx", n=100, natural_frac=0.2, seed=3)
    return s.select("row_idx", "label", "fraud_score", r6("sample_weight").alias("sample_weight"))


@query("class_fraction_resample")
def q_class_fraction_resample(spark, sf_dir):
    s = SM.class_fraction_resample(T.act(spark, sf_dir), "row_idx", n=200, fraction=0.3,
                                   seed=5, label="label")
    return s.select("row_idx", "draw", "label")


@query("holdout_carve")
def q_holdout_carve(spark, sf_dir):
    pool, hold = SM.carve_holdout(T.act(spark, sf_dir), "row_idx", 100, seed=5)
    return (hold.select("row_idx", F.lit("holdout").alias("part"))
            .unionByName(pool.select("row_idx", F.lit("pool").alias("part"))))


@query("load_pairs")
def q_load_pairs(spark, sf_dir):
    """The holdout, carved first, and the class-fraction draw from the rest."""
    train, hold = SM.load_pairs(T.act(spark, sf_dir), "row_idx", 200, 0.3, seed=5, holdout=100, label="label")
    return (train.select(F.lit("train").alias("part"), "row_idx", "draw", "label")
            .unionByName(hold.select(F.lit("holdout").alias("part"), "row_idx", F.lit(0).cast("long").alias("draw"), "label")))


@query("derangement")
def q_derangement(spark, sf_dir):
    return SM.derange(T.act(spark, sf_dir), "row_idx", seed=11)


@query("rollout_expand")
def q_rollout_expand(spark, sf_dir):
    c = T.read_table(spark, sf_dir, "conversations")
    return SM.expand(c, 4).select("conv_id", "turn", "rollout_id")


# --- preprocessing -------------------------------------------------------------------


PREP_CATS = ["merchant", "category", "device"]
PREP_NUMS = ["amt", "hour_of_day", "day_of_week", "amt_zscore", "velocity_1h",
             "velocity_24h", "card_tenure_days"]


def prep_input(spark, sf_dir) -> DataFrame:
    """Causal-feature table with a time split, a ~1000-value device column
    (exceeds the vocabulary cap) and some missing amounts."""
    df = time_split(causal_features(T.txn(spark, sf_dir)))
    # The table feeds the fit (two parameter tables) and the apply: cut its
    # lineage once in the shared checkpoint folder.
    return cut_lineage(df.withColumn("device", F.concat(F.lit("d"),
                                             F.pmod(F.col("txn_id") * 13, F.lit(997)).cast("string")))
            .withColumn("amt", F.when(F.pmod(F.col("txn_id"), F.lit(50)) == 0, F.lit(None))
                        .otherwise(F.col("amt"))))


def _fit(spark, sf_dir):
    df = prep_input(spark, sf_dir)
    vocab, stats = P.fit_preprocessor(df.where(F.col("train_split") == "train"),
                                      PREP_CATS, PREP_NUMS)
    return df, vocab, stats


@query("preprocess_vocab")
def q_preprocess_vocab(spark, sf_dir):
    _, vocab, _ = _fit(spark, sf_dir)
    return vocab.select("col", "value", "id")


@query("preprocess_num_stats")
def q_preprocess_num_stats(spark, sf_dir):
    _, _, stats = _fit(spark, sf_dir)
    return stats.select("col", *[r6(c).alias(c) for c in ["median", "mean", "std", "scale"]])


@query("preprocess_apply")
def q_preprocess_apply(spark, sf_dir):
    df, vocab, stats = _fit(spark, sf_dir)
    out = P.apply_preprocessor(df, vocab, stats)
    return out.select("txn_id", "train_split", *[c + "_id" for c in PREP_CATS],
                      *[r6(c + "_scaled").alias(c + "_scaled") for c in PREP_NUMS])


@query("positive_weight")
def q_positive_weight(spark, sf_dir):
    df = prep_input(spark, sf_dir).where(F.col("train_split") == "train")
    from txnlens.operators.balance import positive_weight
    return positive_weight(df, "is_fraud").select(
        F.col("n_neg").cast("bigint").alias("n_neg"), F.col("n_pos").cast("bigint").alias("n_pos"),
        r6("pos_weight").alias("pos_weight"))


# --- journal, text, rollouts -------------------------------------------------------


@query("latest_by_key")
def q_latest_by_key(spark, sf_dir):
    c = T.read_table(spark, sf_dir, "conversations")
    return J.latest_by_key(c, "conv_id", "turn").select("conv_id", "turn", "role", "text")


def journal_records(spark, sf_dir) -> DataFrame:
    """Journal of summaries keyed by row: every document is a record, and the
    German ones were re-run later (seq 1) with a new text."""
    d = T.read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_idx"), F.col("text").alias("summary"), "lang",
        F.lit(0).alias("seq"))
    rerun = (d.where(F.col("lang") == "de")
             .select("row_idx", F.concat("summary", F.lit(" (rerun)")).alias("summary"), "lang",
                     F.lit(1).alias("seq")))
    return d.unionByName(rerun)


@query("journal_pairs")
def q_journal_pairs(spark, sf_dir):
    """Latest non-blank summary per row joined to its vector (null when the
    row has none)."""
    jr = J.non_blank(J.latest_by_key(journal_records(spark, sf_dir).drop("lang"), "row_idx", "seq"),
                     "summary")
    pairs = J.attach_vectors(jr, T.act(spark, sf_dir), "row_idx")
    return pairs.select("row_idx", F.col("activation_vector").isNotNull().alias("has_vector"),
                        "label", "fraud_score", F.length("summary").cast("bigint").alias("summary_chars"),
                        F.md5("summary").alias("summary_md5"))


@query("pending_work")
def q_pending_work(spark, sf_dir):
    smp = SM.exact_sample(T.act(spark, sf_dir), "row_idx", 300, seed=9)
    # the French summaries have not been generated yet
    done = J.non_blank(journal_records(spark, sf_dir), "summary").where(F.col("lang") != "fr")
    return J.pending(smp, done, "row_idx").select("row_idx")


def explanations(spark, sf_dir) -> DataFrame:
    """All turns wrapped in explanation tags; every third one lost its
    close tag (a truncated generation)."""
    c = T.read_table(spark, sf_dir, "conversations")
    wrapped = X.wrap_explanation("text")
    raw = F.when(F.pmod(F.col("turn"), F.lit(3)) == 0,
                 F.regexp_replace(wrapped, "\n</explanation>$", "")).otherwise(wrapped)
    return c.select("conv_id", "turn", wrapped.alias("wrapped"), raw.alias("raw"))


@query("explanations")
def q_explanations(spark, sf_dir):
    e = explanations(spark, sf_dir)
    return e.select("conv_id", "turn", "wrapped", X.parse_explanation("raw").alias("parsed"),
                    X.has_close_tag("raw").alias("has_close_tag"))


@query("text_stats")
def q_text_stats(spark, sf_dir):
    e = explanations(spark, sf_dir).withColumn("parsed", X.parse_explanation("raw"))
    return e.agg(F.count(F.lit(1)).alias("n"),
                 r6(F.avg(F.length("parsed"))).alias("mean_explanation_chars"),
                 r6(F.lit(100.0) * F.avg(F.when(X.has_close_tag("raw"), 0.0).otherwise(1.0)))
                 .alias("pct_missing_close_tag"))


@query("token_jaccard")
def q_token_jaccard(spark, sf_dir):
    c = T.read_table(spark, sf_dir, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    j = c.join(nxt, ["conv_id", "turn"])
    return j.select("conv_id", "turn", r6(X.token_jaccard("text", "next_text")).alias("jaccard"))


@query("cache_keys")
def q_cache_keys(spark, sf_dir):
    d = T.read_table(spark, sf_dir, "documents")
    return d.select("doc_id", X.cache_key("doc_id", "m").alias("cache_key"))


EOS_ID = 9


def rollouts(spark, sf_dir) -> DataFrame:
    """Rollouts: prompt group = conversation, rollout = turn; token ids and
    log-probs derived from the words of the text; reward from its length."""
    c = T.read_table(spark, sf_dir, "conversations")
    ids = F.transform(F.split("text", " "), lambda w: F.pmod(F.length(w), F.lit(10)).cast("int"))
    return c.select(
        F.col("conv_id").alias("group_id"), F.col("turn").alias("rollout_id"),
        F.pmod(F.col("conv_id"), F.lit(5)).alias("step"),
        ((-F.pmod(F.length("text"), F.lit(97))).cast("double") / 97.0).alias("reward"),
        ids.alias("token_ids"),
        F.transform(ids, lambda x: F.lit(-0.1) * x).alias("logp_policy"),
        F.transform(ids, lambda x: F.lit(-0.12) * x + F.lit(0.01)).alias("logp_ref"))


@query("rollout_advantage")
def q_rollout_advantage(spark, sf_dir):
    r = RO.group_advantage(rollouts(spark, sf_dir), "group_id", "reward")
    return r.select("group_id", "rollout_id", r6("reward").alias("reward"),
                    r6("advantage").alias("advantage"))


@query("rollout_report")
def q_rollout_report(spark, sf_dir):
    r = RO.with_token_stats(rollouts(spark, sf_dir), "token_ids", "logp_policy", "logp_ref", EOS_ID)
    rep = RO.step_report(r)
    return rep.select("step", "n", *[r6(c).alias(c) for c in
                                     ["mean_reward", "mean_mse", "mean_completion_len", "mean_kl"]])


# --- controls and geometry -------------------------------------------------------------


def roundtrip_input(spark, sf_dir) -> DataFrame:
    """Gold / reconstructed vectors with the generated text of each row (the
    document with the same id, wrapped; every fourth lost its close tag)."""
    r = T.recon(spark, sf_dir)
    d = T.read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"), "text")
    j = r.join(d, "row_idx", "left")
    wrapped = X.wrap_explanation(F.coalesce(F.col("text"), F.lit("")))
    raw = F.when(F.pmod(F.col("row_idx"), F.lit(4)) == 0,
                 F.regexp_replace(wrapped, "\n</explanation>$", "")).otherwise(wrapped)
    return j.withColumn("raw", raw).withColumn("parsed", X.parse_explanation("raw"))


@query("roundtrip_report")
def q_roundtrip_report(spark, sf_dir):
    rep = C.roundtrip_report(roundtrip_input(spark, sf_dir), "row_idx", "activation_vector",
                             "pred_vector", "label", "raw", "parsed")
    cols = ["fve_nrm", "mse_nrm", "cos_mean", "cos_median", "cos_p10", "cos_p90",
            "fve_fraud_slice", "mean_explanation_chars", "pct_missing_close_tag"]
    return rep.select("n", F.col("n_fraud").cast("bigint").alias("n_fraud"),
                      *[r6(c).alias(c) for c in cols])


def _swap(spark, sf_dir):
    df = roundtrip_input(spark, sf_dir)
    return C.swap_control(df, "row_idx", "activation_vector", "pred_vector", text="parsed", seed=0)


@query("swap_control_metrics")
def q_swap_control_metrics(spark, sf_dir):
    per, _ = _swap(spark, sf_dir)
    return per.select("condition", "n", *[r6(c).alias(c) for c in
                                          ["fve_nrm", "mse_nrm", "cos_mean", "cos_median"]])


@query("swap_control_verdict")
def q_swap_control_verdict(spark, sf_dir):
    _, v = _swap(spark, sf_dir)
    cols = ["real_fve", "swap_fve", "floor_fve", "gap_real_minus_swap_fve",
            "gap_swap_minus_floor_fve", "jaccard_mean", "jaccard_median"]
    return v.select(*[r6(c).alias(c) for c in cols], "verdict")


@query("pairwise_geometry")
def q_pairwise_geometry(spark, sf_dir):
    """Pair-cosine mean / std before and after reconstruction and their
    Pearson r over all i<j pairs, from moment matrices (no pairs built)."""
    rep = G.pairwise_report(T.recon(spark, sf_dir), "activation_vector", "pred_vector")
    row = [(int(rep["n_pairs"]),) + tuple(round(float(rep[k]), 6) for k in
                                         ["in_mean", "in_std", "out_mean", "out_std", "pearson_r"])]
    return spark.createDataFrame(row, "n_pairs long, in_mean double, in_std double, "
                                      "out_mean double, out_std double, pearson_r double")


PAIR_ORDER = ["in_median", "in_p5", "in_p95", "out_median", "out_p5", "out_p95", "spearman_r", "rank_resolution"]


@query("pair_order_statistics")
def q_pair_order_statistics(spark, sf_dir):
    """Median, p5 and p95 of all pair cosines before and after reconstruction, and the
    rank correlation of the two, from counted products (no pairs stored)."""
    rep = PO.pair_order_report(T.recon(spark, sf_dir), "row_idx", "activation_vector", "pred_vector")
    row = [(rep["n_pairs"], *(None if rep[k] is None else round(float(rep[k]), 6) for k in PAIR_ORDER))]
    return spark.createDataFrame(row, "n_pairs long, " + ", ".join(f"{k} double" for k in PAIR_ORDER))


def _spectrum_df(spark, rows: list[tuple[str, dict]]) -> DataFrame:
    return spark.createDataFrame(
        [(name, r["rows"], r["dims"], r["n_components_90"], r["n_components_99"],
          float(r["effective_rank"]), r["singular_values_top20"], r["singular_values_tail5"])
         for name, r in rows],
        "matrix string, rows long, dims long, n_components_90 int, n_components_99 int, "
        "effective_rank double, singular_values_top20 array<double>, singular_values_tail5 array<double>")


@query("effective_rank")
def q_effective_rank(spark, sf_dir):
    r = T.recon(spark, sf_dir)
    return _spectrum_df(spark, [("gold", G.effective_rank(r, "activation_vector")),
                                ("reconstructed", G.effective_rank(r, "pred_vector"))])


@query("spectrum_energy")
def q_spectrum_energy(spark, sf_dir):
    """Both vector sets' spectra through sums that SQL knows: squared singular values
    add up to the squared norms, their squares to the squared inner products."""
    r = T.recon(spark, sf_dir)
    rows = []
    for name, vec in (("gold", "activation_vector"), ("reconstructed", "pred_vector")):
        m = G.moment_sums(r, [vec])
        eig = np.linalg.eigvalsh(m["G"][vec])
        rows.append((name, m["n"], len(eig), float(eig.sum()), float((eig ** 2).sum())))
    return spark.createDataFrame(rows, "vectors string, n long, dims long, energy double, energy_squared double").select(
        "vectors", "n", "dims", F.round("energy", 4).alias("energy"), F.round("energy_squared", 2).alias("energy_squared"))


@query("pca_spectrum")
def q_pca_spectrum(spark, sf_dir):
    rep = G.pca_spectrum(T.act(spark, sf_dir), "activation_vector", k=50)
    return spark.createDataFrame(
        [(rep["n_components"], rep["components_90pct"], rep["components_95pct"],
          rep["components_99pct"], rep["low_rank_note"], rep["explained_variance_ratio"])],
        "n_components int, components_90pct int, components_95pct int, components_99pct int, "
        "low_rank_note boolean, explained_variance_ratio array<double>")


@query("projection_geometry")
def q_projection_geometry(spark, sf_dir):
    """Affine projection onto the top-16 principal directions, held at norm
    10: geometry kept (pair cosines, Pearson), output rank and norm check."""
    a = T.act(spark, sf_dir)
    w = G.pca_components(a, "activation_vector", 16)
    p = G.project(a, "activation_vector", w, None, 10.0)
    rep = G.pairwise_report(p, "activation_vector", "projected")
    er = G.effective_rank(p, "projected")
    nc = G.norm_check(p, "projected").first()
    return spark.createDataFrame(
        [(int(rep["n_pairs"]), float(rep["in_mean"]), float(rep["out_mean"]),
          float(rep["pearson_r"]), float(er["effective_rank"]), int(er["n_components_90"]),
          float(nc["norm_mean"]), float(nc["norm_std"]))],
        "n_pairs long, in_mean double, out_mean double, pearson_r double, "
        "out_effective_rank double, out_components_90 int, norm_mean double, norm_std double")


#: Rows of the reference block, chosen by a hash of their id.
REFERENCE_ROWS = 200


@query("embedding_space")
def q_embedding_space(spark, sf_dir):
    """Reconstructed vectors against the table of gold vectors: gold norm
    statistics, cosine to the gold mean direction, mean cosine to all gold rows, and
    the distribution of the cosines to a block of reference rows."""
    r = T.recon(spark, sf_dir)
    e = r.select(V.vec_norm("activation_vector").alias("nrm"), "row_idx")
    nstats = M.merge_rows(
        e.agg(F.avg("nrm").alias("norm_mean"), F.stddev_samp("nrm").alias("norm_std")),
        M.exact_quantiles(e, "nrm", {"norm_p5": 0.05, "norm_p95": 0.95},
                          lower={"norm_median": 0.5}, key="row_idx"))
    mdir = M.vector_mean(r, "activation_vector").first()["mean_vector"]
    mnorm = sum(x * x for x in mdir) ** 0.5 + 1e-12
    mcol = F.array(*[F.lit(x / mnorm) for x in mdir])
    cos_m = r.select("row_idx", V.vec_dot(V.unit_geometry("pred_vector"), mcol).alias("c"))
    cstats = M.merge_rows(cos_m.agg(F.avg("c").alias("cos_mean_dir_mean")),
                          M.exact_quantiles(cos_m, "c", {"cos_mean_dir_median": 0.5,
                                                         "cos_mean_dir_p5": 0.05,
                                                         "cos_mean_dir_p95": 0.95}, key="row_idx"))
    su = M.vector_mean(r.select(V.unit_geometry("pred_vector").alias("u")), "u").first()["mean_vector"]
    se = M.vector_mean(r.select(V.unit_geometry("activation_vector").alias("u")), "u").first()["mean_vector"]
    cos_rand = float(sum(a * b for a, b in zip(su, se)))
    block = PO.reference_rows(r, "row_idx", "activation_vector", REFERENCE_ROWS, 11)
    near = PO.reference_cosines(r, "pred_vector", block).ordered(list(PO.QUANTILES.values()))["cos"]
    refs = PO.order_block(near, "cos_reference_")
    out = M.merge_rows(nstats, cstats).withColumn("cos_random_mean", F.lit(cos_rand)).withColumns({k: F.lit(v) for k, v in refs.items()})
    cols = [*refs, "norm_mean", "norm_std", "norm_median", "norm_p5", "norm_p95", "cos_mean_dir_mean",
            "cos_mean_dir_median", "cos_mean_dir_p5", "cos_mean_dir_p95", "cos_random_mean"]
    return out.select(*[r6(c).alias(c) for c in cols])


# --- models ---------------------------------------------------------------------------


# The category column is the fraud label's source in the stand-in, so the
# classifier uses the other features.
CLF_CATS = ["merchant", "device"]


def _prepared(spark, sf_dir):
    # prep_input is cut already; what follows is map-side work
    df, vocab, stats = _fit(spark, sf_dir)
    return P.apply_preprocessor(df, vocab, stats)


@query("classifier_eval")
def q_classifier_eval(spark, sf_dir):
    x = _prepared(spark, sf_dir)
    rep = MD.train_classifier(x, [c + "_id" for c in CLF_CATS], [c + "_scaled" for c in PREP_NUMS], source="sparkov")
    return spark.createDataFrame(
        [(float(rep["reg_param"]), rep["val_auc"], rep["test_auc"], rep["test_ap"],
          rep["pos_weight"], rep["auc_bar"], rep["meets_bar"])],
        "reg_param double, val_auc double, test_auc double, test_ap double, pos_weight double, "
        "auc_bar double, meets_bar boolean")


@query("attribution_prompts")
def q_attribution_prompts(spark, sf_dir):
    """Score rows with the classifier, attribute the logit to the scaled
    numerics (coef * x), list the top 8 and build the generation prompt."""
    from pyspark.ml.functions import vector_to_array
    x = _prepared(spark, sf_dir)
    cat_ids, nums = [c + "_id" for c in CLF_CATS], [c + "_scaled" for c in PREP_NUMS]
    rep = MD.train_classifier(x, cat_ids, nums, reg_grid=(0.01,))
    coef = rep["coefficients"][-len(nums):]
    model = rep["model"]
    scored_df = model.transform(MD._assemble(x, cat_ids, nums)).withColumn(
        "fraud_score", vector_to_array("probability")[1])
    # Attribution of the logit to each scaled numeric, named after the feature.
    attr = MD.linear_attributions(scored_df.select(
        "*", *[F.col(c + "_scaled").alias(c + "_x") for c in PREP_NUMS]),
        {c + "_x": w for c, w in zip(PREP_NUMS, coef)}, suffix="")
    for c in PREP_NUMS:
        attr = attr.withColumnRenamed(c + "_x", c + "_attr")
    text = R.top_attributions(attr, PREP_NUMS, k=8)
    rendered = R.render(attr, "sparkov")
    return attr.select("txn_id", r6("fraud_score").alias("fraud_score"), text.alias("attributions"),
                       R.prompt_text(F.col("fraud_score"), rendered, text).alias("prompt"))


@query("network_fit")
def q_network_fit(spark, sf_dir):
    """The scoring network trained on the preprocessed rows: one row an epoch, and
    the best epoch's weights scored on the test split."""
    df, vocab, stats = _fit(spark, sf_dir)
    x = P.apply_preprocessor(df, vocab, stats)
    sizes = {f"{r['col']}_id": r["n"] for r in vocab.groupBy("col").agg(F.count(F.lit(1)).alias("n")).collect() if r["col"] in CLF_CATS}
    nums = [c + "_scaled" for c in PREP_NUMS]
    fit = NW.train_network(x, "txn_id", dict(sorted(sizes.items())), nums, "is_fraud", hidden=(32, 16), epochs=6, batches=2)
    test = M.auc_ap(NW.scored(x.where("train_split = 'test'"), fit.network, nums, ["is_fraud"]), "score", "is_fraud").first()
    rows = [(h["epoch"], h["loss"], h["val_auc"], h["epoch"] == fit.best_epoch) for h in fit.history]
    out = spark.createDataFrame(rows, "epoch int, loss double, val_auc double, best boolean")
    return out.withColumns({"test_auc": F.when(F.col("best"), F.lit(test["auc_roc"])), "test_ap": F.when(F.col("best"), F.lit(test["average_precision"]))})


@query("logistic_probe")
def q_logistic_probe(spark, sf_dir):
    rep = MD.logistic_probe(T.act(spark, sf_dir), "activation_vector", "label", "row_idx", seed=0)
    return spark.createDataFrame([(rep["probe_auc_roc"], rep["n_probe_samples"], rep["n_train"])],
                                 "probe_auc_roc double, n_probe_samples long, n_train long")


def _md5_weight(prefix: str, half: float):
    def weight(j):
        name = F.concat_ws(":", F.lit(prefix), F.col("id").cast("string"), j.cast("string"))
        return (SM.hash_fraction(F.md5(name)) * 2.0 - 1.0) * F.lit(half)

    return weight


def mlp_weight_table(spark, sizes: list[int], seed: int = 0) -> DataFrame:
    """Weight table ``(layer, row, w, b)`` standing in for a trained checkpoint:
    uniform weights of variance 1/fan_in, each from ``md5("seed:layer:row:col")``
    (the same on any cluster, and in SQL), zero biases."""
    parts = []
    for k, (d_in, d_out) in enumerate(zip(sizes[:-1], sizes[1:])):
        w = F.transform(F.sequence(F.lit(0), F.lit(d_in - 1)), _md5_weight(f"{seed}:{k}", (3.0 / d_in) ** 0.5))
        parts.append(spark.range(d_out).select(F.lit(k).alias("layer"), F.col("id").cast("int").alias("row"),
                                               w.alias("w"), F.lit(0.0).alias("b")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("mlp_scores")
def q_mlp_scores(spark, sf_dir):
    """Scoring network over every preprocessed row: embeddings of the
    categorical ids (widths by the reference's rule) + 7 scaled numerics ->
    32 -> 16 -> 1 with GELU; keeps the 16-d hidden layer and the
    gradient x input attributions of the numerics."""
    df, vocab, stats = _fit(spark, sf_dir)
    x = P.apply_preprocessor(df, vocab, stats)
    cat_ids = [c + "_id" for c in CLF_CATS]
    nums = [c + "_scaled" for c in PREP_NUMS]
    sizes = {r["col"]: r["n"] for r in vocab.groupBy("col").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    rng = np.random.default_rng(0)
    embs = {c + "_id": rng.normal(size=(sizes[c], MD.embedding_dim(sizes[c]))) for c in CLF_CATS}
    d_in = sum(e.shape[1] for e in embs.values()) + len(nums)
    ws = MD.weights_from_table(mlp_weight_table(spark, [d_in, 32, 16, 1]))
    out = MD.mlp_forward(x, "txn_id", nums, ws, capture=1, cat_ids=cat_ids, embeddings=embs,
                         attributions=True)
    return out.select("txn_id", r6("fraud_score").alias("fraud_score"),
                      F.size("activation_vector").alias("dim"),
                      r6(V.vec_norm("activation_vector")).alias("activation_norm"),
                      *[r6(c + "_attr").alias(c + "_attr") for c in nums])


# --- streams over files, run to the end of what is there -------------------------------


def _drained(query) -> None:
    """Wait until the stream has taken in all files, then stop it."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()


@query("stream_causal_features")
def q_stream_causal_features(spark, sf_dir):
    """The streaming causal features of all events, shuffled over several files;
    one row far in the future lets the watermark pass them all."""
    from txnlens.streaming.causal import stream_causal_features
    src, out, ck = (shared_path(spark, n) for n in ("events-in", "events-out", "events-state"))
    t = T.txn(spark, sf_dir).select("txn_id", "card_id", "ts_sec", "amt")
    # files of at most some hundred thousand rows, four at least
    t.repartition(max(4, partitions_for(spark, 4 * t.count())), "txn_id").write.mode("append").parquet(src)

    def drain():
        sdf = spark.readStream.schema(t.schema).parquet(src)
        _drained(stream_causal_features(sdf).writeStream.format("parquet").option("path", out)
                 .option("checkpointLocation", ck).outputMode("append").start())

    drain()
    far = t.agg((F.max("ts_sec") + 10 ** 6).alias("ts_sec"))
    last = far.select(F.lit(-2).alias("txn_id"), F.lit(-2).alias("card_id"), "ts_sec", F.lit(0.0).alias("amt"))
    last.select(*[F.col(f.name).cast(f.dataType) for f in t.schema]).write.mode("append").parquet(src)
    drain()
    got = spark.read.parquet(out).where(F.col("txn_id") != -2)
    return got.select("txn_id", "card_id", "ts_sec", "velocity_1h", "velocity_24h",
                      r6("amt_zscore").alias("amt_zscore"), "card_tenure_days")


@query("stream_journal")
def q_stream_journal(spark, sf_dir):
    """The journal of summaries as a stream of JSON lines; re-run records arrive in
    a second stream with a checkpoint of its own. Last record of each key."""
    from txnlens.streaming.journal import append_records, latest_table, stream_journal
    table = shared_path(spark, "journal-table")
    records = journal_records(spark, sf_dir).select(
        "row_idx", "summary", F.lit(None).cast("string").alias("features_json"), F.lit(None).cast("double").alias("fraud_score"),
        F.lit(None).cast("int").alias("label"), F.col("seq").cast("long").alias("seq"))
    for seq in (0, 1):
        src = shared_path(spark, "journal-in")
        append_records(records.where(F.col("seq") == seq), src)
        _drained(stream_journal(spark, src, table, shared_path(spark, "journal-state")))
    return latest_table(spark, table).select("row_idx", "seq", F.md5("summary").alias("summary_md5"))


@query("stream_step_metrics")
def q_stream_step_metrics(spark, sf_dir):
    """Per-step metrics of a stream of training samples: every conversation turn is
    a sample of its step."""
    from txnlens.streaming.journal import stream_step_metrics
    src, out = shared_path(spark, "samples-in"), shared_path(spark, "samples-out")
    c = T.read_table(spark, sf_dir, "conversations")
    c.select(F.col("turn").cast("long").alias("step"), (-F.length("text") / F.lit(1000.0)).alias("reward"),
             (F.pmod(F.col("conv_id"), F.lit(7)) / F.lit(8.0)).alias("mse"), X.wrap_explanation("text").alias("explanation")).write.json(src)

    def keep(batch, _):
        batch.write.mode("overwrite").parquet(out)

    _drained(stream_step_metrics(spark, src).writeStream.outputMode("complete").foreachBatch(keep)
             .option("checkpointLocation", shared_path(spark, "samples-state")).start())
    return spark.read.parquet(out).select("step", r6("mean_reward").alias("mean_reward"), r6("mean_mse").alias("mean_mse"),
                                          r6("mean_explanation_chars").alias("mean_explanation_chars"), "n")


@query("tail_step_metrics")
def q_tail_step_metrics(spark, sf_dir):
    """Per-step metrics of sample files that grow in place: every file is appended to
    between two runs of one query, the first time with a line that is only half
    written."""
    from txnlens.streaming.journal import follow_step_metrics
    from txnlens.streaming.tail import grow, record_line
    src, out, ck = (shared_path(spark, f"tail-{k}") for k in ("in", "out", "state"))
    c = T.read_table(spark, sf_dir, "conversations").select(
        "conv_id", F.col("turn").cast("long").alias("step"), (-F.length("text") / F.lit(1000.0)).alias("reward"),
        (F.pmod(F.col("conv_id"), F.lit(7)) / F.lit(8.0)).alias("mse"), X.wrap_explanation("text").alias("explanation"),
        F.pmod(F.col("conv_id"), F.lit(3)).cast("int").alias("stage"))
    lines = c.withColumn("line", F.expr(record_line(["step", "reward", "mse", "explanation"])))

    def keep(batch, _):
        batch.write.mode("overwrite").parquet(out)

    for until in (0, 1, 2):
        grow(lines, src, ["conv_id", "step"], "line", "stage", until, torn=40)
        _drained(follow_step_metrics(spark, src).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", ck).start())
    return spark.read.parquet(out).select("step", r6("mean_reward").alias("mean_reward"), r6("mean_mse").alias("mean_mse"),
                                          r6("mean_explanation_chars").alias("mean_explanation_chars"), "n")


@query("tail_journal")
def q_tail_journal(spark, sf_dir):
    """The journal in files that grow in place: re-run records are appended to the
    files that the stream has read. Last record of each key."""
    from txnlens.streaming.journal import follow_journal, latest_table
    from txnlens.streaming.tail import grow, record_line
    src, table, ck = (shared_path(spark, f"tail-journal-{k}") for k in ("in", "table", "state"))
    records = journal_records(spark, sf_dir).select("row_idx", "summary", F.col("seq").cast("long").alias("seq"))
    lines = records.withColumn("line", F.expr(record_line(["row_idx", "summary", "seq"])))
    for seq in (0, 1):
        grow(lines, src, ["row_idx"], "line", "seq", seq, torn=25)
        _drained(follow_journal(spark, src, table, ck))
    return latest_table(spark, table).select("row_idx", "seq", F.md5("summary").alias("summary_md5"))


# --- evaluations specified by the plan -------------------------------------------------


def predictions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(truth, predictions): two systems guess each vector's score bucket and
    label -- 'shifted' from a shifted score, 'majority' from the training
    majority label and mean score."""
    a = T.act(spark, sf_dir)
    truth = a.select("row_idx", "label", S.score_bin("fraud_score").alias("score_bin"), "class_id")
    base = EV.majority_baseline(a, "label", "fraud_score").first()
    # a masked feature: the systems see the row without its class
    common = EV.majority_baseline(a, "class_id", "fraud_score").first()["majority_label"]
    shifted = F.pmod(F.col("row_idx") * 37 + 5, F.lit(101)) / F.lit(100.0)
    p1 = a.select(F.lit("shifted").alias("system"), "row_idx",
                  S.score_bin(shifted).alias("pred_bin"), (shifted >= 0.5).cast("int").alias("pred_label"),
                  F.pmod(F.col("row_idx") * 7 + 3, F.lit(10)).cast("int").alias("pred_class"))
    p2 = a.select(F.lit("majority").alias("system"), "row_idx",
                  S.score_bin(F.lit(float(base["mean_score"]))).alias("pred_bin"),
                  F.lit(int(base["majority_label"])).alias("pred_label"), F.lit(int(common)).alias("pred_class"))
    return truth, p1.unionByName(p2)


TASKS = {"score_bucket": ("pred_bin", "score_bin"), "label": ("pred_label", "label"),
         "masked_feature": ("pred_class", "class_id")}


@query("accuracy_by_system")
def q_accuracy_by_system(spark, sf_dir):
    truth, pred = predictions(spark, sf_dir)
    acc = EV.accuracy_by_system(pred, truth, "row_idx", TASKS)
    return acc.select("system", "task", "n", r6("accuracy").alias("accuracy"))


@query("comparison_table")
def q_comparison_table(spark, sf_dir):
    truth, pred = predictions(spark, sf_dir)
    acc = EV.accuracy_by_system(pred, truth, "row_idx", TASKS)
    t = EV.comparison_table(acc, list(TASKS))
    return t.select("system", *[r6(c).alias(c) for c in TASKS])


@query("model_error_slice")
def q_model_error_slice(spark, sf_dir):
    return EV.model_error_slice(T.act(spark, sf_dir), "fraud_score", "label")


@query("claim_precision")
def q_claim_precision(spark, sf_dir):
    """Claims read back from the rendered card-present text, checked against
    the features they were rendered from."""
    df = causal_features(T.txn(spark, sf_dir))
    txt = df.select("txn_id", R.render(df, "sparkov").alias("rendered"))
    claims = EV.claims_from_text(txt, "rendered", "txn_id")
    return EV.claim_precision(claims, df, "txn_id").select("kind", "n_claims",
                                                            r6("precision").alias("precision"))


def random_direction(d: int, seed: int = 0) -> list[float]:
    """Seeded random steering direction (values rounded to 12 places so the
    SQL oracle can state them as literals)."""
    return [round(float(x), 12) for x in np.random.default_rng(seed).normal(size=d)]


STEER_ALPHAS = [0.25, 0.5, 1.0, 2.0]


@query("steering_sweep")
def q_steering_sweep(spark, sf_dir):
    """Steer vectors along the class-mean difference, a seeded random direction and
    a probe's: the covariance of the vectors with the score, which is the first
    step of a linear read-out. Scored by cosine with the class-mean difference."""
    a = T.act(spark, sf_dir)
    means = {r["label"]: r["mean_vector"] for r in M.vector_mean(a, "activation_vector", by=["label"]).collect()}
    delta = (np.asarray(means[1]) - np.asarray(means[0])).tolist()
    rnd = random_direction(len(delta))
    x = a.select("fraud_score", F.transform("activation_vector", lambda v: v.cast("double")).alias("x"))
    probe = list(x.agg(*[F.covar_pop(F.element_at("x", i + 1), F.col("fraud_score")).alias(f"c{i}") for i in range(len(delta))]).first())
    s = EV.steering_sweep(a, "activation_vector", {"class_mean": delta, "random": rnd, "probe": probe},
                          STEER_ALPHAS, delta)
    return s.select("direction", "alpha", "n", r6("mean_score").alias("mean_score"))


def _steering_directions(a: DataFrame) -> dict[str, list[float]]:
    """The class-mean difference, a seeded random direction and the covariance of the
    vectors with the score."""
    means = {r["label"]: r["mean_vector"] for r in M.vector_mean(a, "activation_vector", by=["label"]).collect()}
    delta = (np.asarray(means[1]) - np.asarray(means[0])).tolist()
    x = a.select("fraud_score", F.transform("activation_vector", lambda v: v.cast("double")).alias("x"))
    probe = list(x.agg(*[F.covar_pop(F.element_at("x", i + 1), F.col("fraud_score")).alias(f"c{i}") for i in range(len(delta))]).first())
    return {"class_mean": delta, "random": random_direction(len(delta)), "probe": probe}


STEER_HIDDEN = 16


@query("steering_network")
def q_steering_network(spark, sf_dir):
    """Steered vectors enter the network again behind the captured layer: mean score,
    shift and share of lower scores for every direction and alpha, none included."""
    a = T.act(spark, sf_dir)
    directions = _steering_directions(a)
    layers = MD.weights_from_table(mlp_weight_table(spark, [len(directions["random"]), STEER_HIDDEN, 1]))
    s = EV.network_steering(a, "activation_vector", directions, [0.0, *STEER_ALPHAS], layers)
    return s.select("direction", "alpha", "n", r6("mean_score").alias("mean_score"), r6("mean_shift").alias("mean_shift"), r6("share_lower").alias("share_lower"))


@query("holdout_overlap")
def q_holdout_overlap(spark, sf_dir):
    """Train / holdout guard: the training draw comes from the pool only, so
    its overlap with the holdout must be 0."""
    pool, hold = SM.carve_holdout(T.act(spark, sf_dir), "row_idx", 100, seed=5)
    train = SM.exact_sample(pool, "row_idx", 200, seed=6)
    return J.overlap_count(train, hold, "row_idx").select(F.col("n_overlap").cast("bigint"))


@query("features_json")
def q_features_json(spark, sf_dir):
    """Per row of the stratified sample: its features (weight included, score
    excluded) as JSON."""
    s = SM.stratified_sample(T.act(spark, sf_dir).drop("class_id"), "row_idx", n=100,
                             natural_frac=0.2, seed=3)
    s = s.withColumn("sample_weight", r6("sample_weight"))  # printed to 6 places
    return s.select("row_idx", R.features_json(s).alias("features_json"))


@query("pc_correlations")
def q_pc_correlations(spark, sf_dir):
    """Linear read-out per principal component: correlation of each of the
    top 8 components with the label and with the score."""
    return G.pc_correlations(T.act(spark, sf_dir), "activation_vector", 8, ["label", "fraud_score"])


@query("attribution_text")
def q_attribution_text(spark, sf_dir):
    """Top-5 attribution lines from a linear scorer whose weights are the
    train-split correlations of each scaled numeric with the label: the
    gradient x input of its logit is ``w_c * x_c``."""
    df, vocab, stats = _fit(spark, sf_dir)
    x = P.apply_preprocessor(df, vocab, stats)
    train = x.where(F.col("train_split") == "train")
    # one coefficient per numeric feature: a bounded one-row result
    w = train.agg(*[F.corr(F.col(c + "_scaled").cast("double"), F.col("is_fraud").cast("double"))
                    .alias(c) for c in PREP_NUMS]).first()
    attr = x.select("txn_id", *[(F.col(c + "_scaled").cast("double") * F.lit(w[c])).alias(c + "_attr")
                                for c in PREP_NUMS if w[c] is not None])
    return attr.select("txn_id", R.top_attributions(attr, PREP_NUMS, k=5).alias("attributions"))


@query("distribution_block")
def q_distribution_block(spark, sf_dir):
    """Distribution of the per-row cosine between gold and reconstructed
    vectors, per label: mean, interpolated median, p5, p95, population std, n."""
    r = T.recon(spark, sf_dir).select("row_idx", "label",
                                      V.cosine("pred_vector", "activation_vector").alias("cos"))
    b = M.distribution_block(r, "cos", by=["label"], key="row_idx")
    return b.select("label", "n", *[r6(c).alias(c) for c in ["mean", "median", "p5", "p95", "std"]])


@query("probe_ceiling")
def q_probe_ceiling(spark, sf_dir):
    """How much of each input feature a linear read-out recovers from the
    scoring network's 16-d hidden layer (held-out R^2)."""
    x = _prepared(spark, sf_dir)
    nums = [c + "_scaled" for c in PREP_NUMS]
    ws = MD.weights_from_table(mlp_weight_table(spark, [len(nums), 32, 16, 1]))
    h = MD.mlp_forward(x, "txn_id", nums, ws, capture=1)
    j = h.join(x.select("txn_id", *nums), "txn_id")
    return MD.probe_ceiling(j, "activation_vector", nums, "txn_id")


@query("component_probes")
def q_component_probes(spark, sf_dir):
    """Read-out of label, score and a target with nulls from every vector component
    alone, fitted on four fifths of the rows and scored on the rest; one scan."""
    a = T.act(spark, sf_dir).withColumn("thinned", F.when(F.pmod("row_idx", F.lit(3)) != 0, F.col("fraud_score")))
    p = PB.component_probes(a, "activation_vector", ["label", "fraud_score", "thinned"], F.pmod("row_idx", F.lit(5)) == 0)
    return p.select("feature", "component", "n_train", "n_test", r6("slope").alias("slope"), r6("intercept").alias("intercept"), r6("r2_train").alias("r2_train"), r6("r2_test").alias("r2_test"))


# --- files: raw CSV in, committed tables out ---------------------------------------------

def _csv_files(df: DataFrame, path: str, odd: F.Column) -> str:
    """Two folders of CSV files: the columns as they are, and turned round behind one
    more column, for the odd rows."""
    df.where(~odd).write.option("header", True).csv(f"{path}/a")
    df.where(odd).select(F.lit("x,y").alias("note"), *reversed(df.columns)).write.option("header", True).csv(f"{path}/b")
    return path


@query("csv_ecom")
def q_csv_ecom(spark, sf_dir):
    """Orders written as transaction and identity CSV files (two header layouts, one with
    a column more) and read back by header name."""
    from txnlens.sources import ingest as I
    o, key = T.read_table(spark, sf_dir, "orders"), F.col("o_orderkey")
    tx = o.select(
        key.alias("TransactionID"), (F.col("o_orderstatus") == "P").cast("int").alias("isFraud"),
        (T.unix_sec("o_orderdate") - S.epoch_seconds(S.offset_to_timestamp(F.lit(0)))).alias("TransactionDT"), F.col("o_totalprice").alias("TransactionAmt"),
        F.substring("o_orderpriority", 3, 1).alias("ProductCD"), F.col("o_custkey").alias("card1"), F.lower("o_orderpriority").alias("card4"),
        F.when(F.col("o_orderstatus") == "F", "debit").alias("card6"), F.pmod(key, F.lit(7)).cast("double").alias("addr1"),
        F.lit(None).cast("double").alias("addr2"), F.when(F.pmod(key, F.lit(4)) == 0, F.col("o_totalprice") / 8).alias("dist1"),
        F.when(F.pmod(key, F.lit(2)) == 0, "gmail.com").alias("P_emaildomain"), F.concat(F.lit('a "quoted", b '), key).alias("R_emaildomain"))
    ident = o.where(F.pmod(key, F.lit(3)) != 2).select(F.lit(1).alias("id_01"), F.concat(F.lit("dev "), key).alias("DeviceInfo"), F.lit("mobile").alias("DeviceType"), key.alias("TransactionID"))
    odd = F.pmod("TransactionID", F.lit(2)) == 1
    base = _csv_files(tx, shared_path(spark, "csv-tx"), odd)
    back = I.load_ecom_csv(spark, f"{base}/*", f"{_csv_files(ident, shared_path(spark, 'csv-id'), odd)}/*")
    return back.select("TransactionID", F.col("is_fraud").cast("bigint").alias("is_fraud"), "TransactionAmt", "ProductCD", "card1", "card4", "card6",
                       "addr1", "addr2", "dist1", "P_emaildomain", "R_emaildomain", "DeviceType", "DeviceInfo", "ts_sec", "dataset_source",
                       *[F.col(c).cast("bigint").alias(c) for c in ("hour_of_day", "day_of_week")])


@query("csv_card_present")
def q_csv_card_present(spark, sf_dir):
    """Events written as card-present CSV files in nested folders and read back."""
    from txnlens.sources import ingest as I
    t = T.with_geo(T.txn(spark, sf_dir))
    raw = t.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("trans_date_trans_time"), F.concat(F.lit("4"), "card_id").alias("cc_num"), "merchant", "category", "amt",
        F.when(F.pmod("txn_id", F.lit(2)) == 0, "F").alias("gender"), F.lit("c").alias("city"), F.lit("s").alias("state"), F.lpad(F.col("card_id").cast("string"), 5, "0").alias("zip"),
        "lat", "long", F.col("txn_id").alias("city_pop"), F.lit("j").alias("job"), F.date_format("dob", "yyyy-MM-dd").alias("dob"), "merch_lat", "merch_long", "is_fraud")
    base = _csv_files(raw, shared_path(spark, "csv-cards"), F.pmod("city_pop", F.lit(2)) == 1)
    back = I.load_card_present_csv(spark, base)
    return back.select(F.col("city_pop").alias("txn_id"), "cc_num", "merchant", "category", "amt", "gender", "zip", "lat", "long", "merch_lat", "merch_long", "ts_sec",
                       F.col("is_fraud").cast("bigint").alias("is_fraud"), *[F.col(c).cast("bigint").alias(c) for c in ("hour_of_day", "day_of_week")])


@query("committed_splits")
def q_committed_splits(spark, sf_dir):
    """Orders committed by split; then the validation split again: an attempt that
    dies half-way, the same run once more, and the run repeated after its commit. Read
    back without the training split."""
    from pyspark.errors import PySparkException
    from txnlens.sources.versions import commit_table, read_committed
    path, last = shared_path(spark, "committed"), F.pmod("o_orderkey", F.lit(10))
    o = T.read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.when(last == 8, "val").when(last == 9, "test").otherwise("train").alias("train_split"))
    commit_table(o, path, "first")

    def again(factor: int, dies: bool = False) -> DataFrame:
        price = F.col("o_totalprice") * factor
        if dies:
            price = F.when(F.pmod("o_orderkey", F.lit(20)) == 8, F.raise_error(F.lit("lost")).cast("double")).otherwise(price)
        return o.where(F.col("train_split") == "val").withColumn("o_totalprice", price)

    try:
        commit_table(again(5, dies=True), path, "second")
    except PySparkException:
        pass
    commit_table(again(2), path, "second")
    commit_table(again(3), path, "second")
    return read_committed(spark, path).where(F.col("train_split") != "train")


@query("prompt_text")
def q_prompt_text(spark, sf_dir):
    """The generation prompt per row: the score of the correlation-weighted
    linear scorer (logistic of sum w_c x_c), the row rendered as English and
    its top-8 attribution lines."""
    df, vocab, stats = _fit(spark, sf_dir)
    x = P.apply_preprocessor(df, vocab, stats)
    train = x.where(F.col("train_split") == "train")
    w = train.agg(*[F.corr(F.col(c + "_scaled").cast("double"), F.col("is_fraud").cast("double"))
                    .alias(c) for c in PREP_NUMS]).first()
    used = [c for c in PREP_NUMS if w[c] is not None]
    terms = [F.col(c + "_scaled").cast("double") * F.lit(w[c]) for c in used]
    logit = terms[0]
    for t in terms[1:]:
        logit = logit + t
    y = x.select("*", *[t.alias(c + "_attr") for t, c in zip(terms, used)],
                 S.logistic(logit).alias("fraud_score"))
    rendered = R.render(y.select("merchant", "category", "amt", "hour_of_day", "day_of_week",
                                 "velocity_1h", "velocity_24h", "amt_zscore", "card_tenure_days",
                                 "fraud_score"), "sparkov")
    text = R.top_attributions(y, PREP_NUMS, k=8)
    return y.select("txn_id", R.prompt_text(F.col("fraud_score"), rendered, text).alias("prompt"))
