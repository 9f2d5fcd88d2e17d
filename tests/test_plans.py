"""Plan shape checks and scale-path equivalence."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001, SF01
from txnlens.functions import render as R
from txnlens.operators import sampling as SM
from txnlens.operators.causal import causal_features, largest_group_rows
from txnlens.operators.ordering import time_split
from txnlens.sources import tables as T


def _executed(df) -> str:
    df.collect()  # runs this DataFrame's own query execution (final AQE plan)
    return df._jdf.queryExecution().executedPlan().toString()


def test_rank_shares_one_range_exchange(spark):
    # input comes out of a shuffle (window), the case where two independently
    # sampled range exchanges could disagree
    from txnlens.operators.ordering import rank_table
    src = causal_features(T.txn(spark, SF01), strategy="window")
    r = rank_table(src.where(F.col("velocity_24h") >= 0), ["ts_sec", "txn_id"], rank_col="_r")
    agg = r.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("_r").alias("d"),
                F.min("_r").alias("lo"), F.max("_r").alias("hi"))
    plan = _executed(agg)
    assert "ReusedExchange" in plan
    row = agg.first()
    assert (row.n, row.d, row.lo, row.hi) == (10000, 10000, 0, 9999)


def test_time_split_never_shuffles_rows(spark):
    df = time_split(T.txn(spark, SF01))
    final = _executed(df.select("txn_id", "train_split")).split("== Initial Plan ==")[0]
    assert "Exchange" not in final
    got = {r.train_split: r["count"] for r in df.groupBy("train_split").count().collect()}
    assert got == {"train": 8000, "val": 1000, "test": 1000}


def test_window_path_single_exchange(spark):
    df = causal_features(T.txn(spark, SF01), strategy="window").select(
        "txn_id", "velocity_1h", "amt_zscore")
    final = _executed(df).split("== Initial Plan ==")[0]
    assert "SinglePartition" not in final
    assert final.count("Exchange hashpartitioning") == 1


def test_hot_card_skew_path_matches_window(spark):
    # one card holds a third of the rows
    base = T.txn(spark, SF01)
    hot = base.withColumn("card_id", F.when(F.pmod(F.col("txn_id"), F.lit(3)) == 0, F.lit(-1))
                          .otherwise(F.col("card_id")))
    assert largest_group_rows(hot, "card_id") >= 3333
    cols = ["txn_id", "velocity_1h", "velocity_24h", "amt_zscore", "card_tenure_days"]
    a = {r.txn_id: r for r in causal_features(hot, strategy="window").select(*cols).collect()}
    b = {r.txn_id: r for r in causal_features(hot, strategy="auto", max_card_rows=1000,
                                              num_partitions=16).select(*cols).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert (a[k].velocity_1h, a[k].velocity_24h) == (b[k].velocity_1h, b[k].velocity_24h)
        assert abs(a[k].amt_zscore - b[k].amt_zscore) <= 1e-6 * max(1.0, abs(a[k].amt_zscore))
        assert a[k].card_tenure_days == b[k].card_tenure_days


def test_entry_smoke(spark):
    import __spark_entry__ as E
    rows = E.entry(spark).collect()
    assert {r.train_split for r in rows} == {"train", "val", "test"}
    assert set(E.oracle_sql()) <= set(E.queries())


def test_verbalizability_coverage(spark):
    feats = ["ProductCD", "TransactionAmt", "addr1", "r_email_group", "not_rendered"]
    missing = [r.feature for r in R.unverbalized(spark, "ieee-fraud-detection", feats).collect()]
    assert missing == ["not_rendered"]
    assert R.verbalizability_table(spark, "synthetic").count() == 11


def test_floor_per_cell():
    q = SM.water_fill({"a": 100, "b": 3, "c": 50}, 20, min_per_cell=5)
    assert q == {"a": 9, "b": 3, "c": 8}


def test_features_json(spark):
    df = spark.createDataFrame([(1, 0.5, 1, 2.0, None, 0.3)],
                               "row_idx long, fraud_score double, label int, sample_weight double, "
                               "merchant string, amt_attr double")
    js = df.select(R.features_json(df)).first()[0]
    assert js == '{"row_idx":1,"sample_weight":2.0,"merchant":null}'


def test_prefix_sums_share_one_range_exchange(spark):
    from txnlens.operators import metrics as M
    from txnlens.plans.registry import scored
    a = M.auc_ap(scored(spark, SF01), "score", "label")
    plan = _executed(a)
    assert "ReusedExchange" in plan


def test_skew_path_shares_one_range_exchange(spark):
    from txnlens.operators.causal import causal_feature_table
    t = T.txn(spark, SF01)
    shuffled = t.groupBy("txn_id").agg(F.first("card_id").alias("card_id"),
                                       F.first("ts_sec").alias("ts_sec"), F.first("amt").alias("amt"))
    plan = _executed(causal_feature_table(shuffled, num_partitions=8))
    assert "ReusedExchange" in plan


def test_pruning_and_pushdown(spark):
    from txnlens.plans import inspect as PI
    import __spark_entry__ as E
    from txnlens.operators import sampling as SM
    users = T.read_table(spark, SF01, "conversations").where(F.col("role") == "user")
    s = PI.summary(SM.expand(users, 4).select("conv_id", "turn", "rollout_id"))
    conv = [x for x in s["scans"] if "conv_id" in (x["read_schema"] or "")]
    assert conv and "EqualTo(role,user)" in conv[0]["pushed_filters"]
    # only the columns the query needs are read
    assert "text" not in conv[0]["read_schema"]
    s2 = PI.summary(E.queries()["causal_features"](spark, SF01))
    assert s2["exchanges"]["single"] == 0
    assert all("props" not in (x["read_schema"] or "") for x in s2["scans"])


def test_select_positions_matches_rank(spark):
    from txnlens.operators.ordering import rank_table, select_positions
    base = T.txn(spark, SF01).select("ts_sec", "txn_id")
    # a timestamp holding a third of the rows forces refinement on the id
    hot = base.withColumn("ts_sec", F.when(F.pmod(F.col("txn_id"), F.lit(3)) == 0,
                                           F.lit(1704100000)).otherwise(F.col("ts_sec")))
    for df in (base, hot):
        ranks = {r._r: (r.ts_sec, r.txn_id) for r in
                 rank_table(df, ["ts_sec", "txn_id"], rank_col="_r").collect()}
        pos = [0, 1, 4321, 8000, 9000, 9999, 10000]
        got = select_positions(df, ["ts_sec", "txn_id"], pos, band_max=50, buckets=8)
        for p in pos:
            assert got[p] == ranks.get(p), p


def test_select_quantiles_matches_numpy(spark):
    import numpy as np
    from txnlens.operators import ordering as O
    rng = np.random.default_rng(5)
    rows = [("a", float(v)) for v in rng.normal(size=3001)] + \
           [("b", float(v)) for v in rng.integers(0, 5, size=2000)] + [("c", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double")
    a = np.array([v for g, v in rows if g == "a" and v == v])
    b = np.array([v for g, v in rows if g == "b"])
    res = O.select_quantiles(df, "g", "x", {"m": 0.5, "p9": 0.9})
    assert res["a"]["m"] == pytest.approx(np.percentile(a, 50))
    assert res["a"]["p9"] == pytest.approx(np.percentile(a, 90))
    assert res["b"]["m"] == pytest.approx(np.percentile(b, 50))
    vals = O.select_values(df, "g", "x", {"a": [0, 1500, 3000], "b": [999]}, buckets=4, final=5)
    s = np.sort(a)
    assert [vals[("a", p)] for p in (0, 1500, 3000)] == [s[0], s[1500], s[3000]]
    assert vals[("b", 999)] == np.sort(b)[999]


def test_searches_of_one_band_read_a_row_once(spark, monkeypatch):
    from txnlens.operators import ordering as O
    df = spark.createDataFrame([("a", float(v * 7 % 101)) for v in range(101)] + [("b", -1.5), ("b", None)], "g string, x double")
    seen, ranked = [], O.rank_table
    monkeypatch.setattr(O, "rank_table", lambda rows, *a, **k: seen.append(rows.count()) or ranked(rows, *a, **k))
    vals = O.select_values(df, "g", "x", {"a": [50, 51], "b": [0]}, final=1000)
    assert (vals[("a", 50)], vals[("a", 51)], vals[("b", 0)]) == (50.0, 51.0, -1.5)
    assert seen == [101]
    vals = O.select_values(df, "g", "x", {"a": list(range(101))}, buckets=5, final=1)  # bands part, pass by pass
    assert [vals[("a", p)] for p in range(101)] == [float(p) for p in range(101)]


def test_num_stats_selection_path_matches_rank_path(spark, monkeypatch):
    from txnlens.operators import preprocess as P
    from txnlens.plans.registry import PREP_NUMS, prep_input
    train = prep_input(spark, SF01).where(F.col("train_split") == "train")
    small = {r.col: r for r in P.fit_num_stats(train, PREP_NUMS).collect()}
    monkeypatch.setattr(P, "SELECT_BAND_MAX", 0)        # force histogram selection
    big = {r.col: r for r in P.fit_num_stats(train, PREP_NUMS).collect()}
    for c in PREP_NUMS:
        assert big[c].median == pytest.approx(small[c].median, rel=1e-12, abs=1e-12)
        assert big[c].std == pytest.approx(small[c].std, rel=1e-9)


def test_without_exchange_reuse(spark):
    from txnlens.operators.ordering import rank_table
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        src = causal_features(T.txn(spark, SF01), strategy="window").where(F.col("velocity_1h") >= 0)
        r = rank_table(src, ["ts_sec", "txn_id"], rank_col="_r")
        row = r.agg(F.countDistinct("_r").alias("d"), F.max("_r").alias("hi")).first()
        assert (row.d, row.hi) == (10000, 9999)
        a = {x.txn_id: x.velocity_24h for x in causal_features(T.txn(spark, SF01), strategy="skew",
                                                                num_partitions=8).collect()}
        b = {x.txn_id: x.velocity_24h for x in causal_features(T.txn(spark, SF01), strategy="window").collect()}
        assert a == b
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")
