"""Golden cases derived by hand from the reference's rules (FIXTURES.md 3)."""

import math

import pytest
from pyspark.sql import functions as F

from txnlens.functions import render as R
from txnlens.functions import scalar as S
from txnlens.functions import text as X
from txnlens.functions import vectors as V
from txnlens.operators.causal import causal_features
from txnlens.operators.ordering import split_sizes, time_split

ECOM_ROW = {
    "ProductCD": "r", "TransactionAmt": 1249.0, "hour_of_day": 13.0, "day_of_week": 1.0,
    "card4": "mastercard", "card6": "credit", "P_emaildomain": "acme.example",
    "R_emaildomain": "acme.example", "p_email_group": "corporate", "r_email_group": "corporate",
    "email_match": 1.0, "DeviceType": "desktop", "DeviceInfo": "missing",
    "addr1": 512.0, "addr2": 60.0, "dist1": 17.0,
    "velocity_1h": 0.0, "velocity_24h": 2.0, "amt_zscore": -1.26,
    "card_tenure_days": 75.0, "fraud_score": 0.0456,
}
# upper-cased code; equal domains are not repeated; a "missing" device has no brackets
ECOM_TEXT = (
    "Transaction type: retail purchase; Amount: $1249.00; Time: 13:xx (afternoon), Tuesday; "
    "Card: mastercard credit; Purchaser email: acme.example [corporate]; "
    "Email match: purchaser and recipient domains match; Device: desktop; "
    "Geography: country code 60, billing zip prefix 512, address–card distance 17 mi; "
    "Card velocity: 0 txn in past 1h; Card velocity: 2 txn in past 24h; "
    "Amount vs card history: z=-1.3 (below average); Card tenure: 75 days (2.5 months); "
    "Model fraud score: 0.046.")
CP_ROW = {
    "merchant": "Corner Books", "category": "shopping_pos",
    "amt": 33.2, "hour_of_day": 9.0, "day_of_week": 6.0,
    "geo_distance_km": 48.04, "age_at_txn": 57.6,
    "velocity_1h": 1.0, "velocity_24h": 1.0, "amt_zscore": 2.5,
    "card_tenure_days": 12.0, "fraud_score": 0.75,
}
CP_TEXT = (
    "Merchant: Corner Books (retail shopping (in-person)); Amount: $33.20; "
    "Time: 09:xx (morning), Sunday; Cardholder age: 58 years; "
    "Distance home→merchant: 48.0 km (nearby); Card velocity: 1 txn in past 1h; "
    "Card velocity: 1 txn in past 24h; Amount vs card history: z=+2.5 (high); "
    "Card tenure: 12 days; Model fraud score: 0.750.")


def _one(spark, row):
    return spark.createDataFrame([row])


def test_render_ecom_golden(spark):
    df = _one(spark, ECOM_ROW)
    assert df.select(R.render(df, "ieee-fraud-detection")).first()[0] == ECOM_TEXT


def test_render_card_present_golden(spark):
    df = _one(spark, CP_ROW)
    assert df.select(R.render(df, "sparkov")).first()[0] == CP_TEXT


def test_render_unknown_source_is_ecom(spark):
    df = _one(spark, ECOM_ROW)
    assert df.select(R.render(df, "something-else")).first()[0] == ECOM_TEXT


def test_render_all_missing(spark):
    row = {k: None for k in ECOM_ROW}
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}"
                       for k, v in ECOM_ROW.items())
    df = spark.createDataFrame([tuple(row.values())], schema)
    assert df.select(R.render(df, "ieee-fraud-detection")).first()[0] == "."
    assert df.select(R.render(df, "sparkov")).first()[0] == "."


def test_causal_golden(spark):
    rows = [(1, 7, 0, 10.0), (2, 7, 3600, 10.0), (3, 7, 3601, 20.0), (4, 7, 86400, 20.0),
            (5, 7, 86401, 30.0)]
    df = spark.createDataFrame(rows, "txn_id long, card_id long, ts_sec long, amt double")
    exp = {1: (0, 0, 0.0, 0.0), 2: (1, 1, 0.0416667, 0.0), 3: (1, 2, 0.0416782, 1e7),
           4: (0, 3, 1.0, 1.414213), 5: (1, 3, 1.0000116, 2.9999994)}
    for strat in ("window", "skew"):
        got = {r.txn_id: r for r in causal_features(df, strategy=strat, num_partitions=3).collect()}
        for k, (v1, v24, ten, z) in exp.items():
            r = got[k]
            assert (r.velocity_1h, r.velocity_24h) == (v1, v24), (strat, k)
            assert r.card_tenure_days == pytest.approx(ten, abs=1e-6)
            assert r.amt_zscore == pytest.approx(z, rel=1e-6, abs=1e-6)


def test_causal_ties_and_null_card(spark):
    rows = [(1, 5, 100, 1.0), (2, 5, 100, 2.0), (3, None, 100, 3.0), (4, None, 100, 4.0)]
    df = spark.createDataFrame(rows, "txn_id long, card_id long, ts_sec long, amt double")
    for strat in ("window", "skew"):
        got = {r.txn_id: r for r in causal_features(df, strategy=strat).collect()}
        assert got[1].velocity_1h == 0 and got[2].velocity_1h == 1
        for k in (3, 4):
            assert (got[k].velocity_1h, got[k].velocity_24h, got[k].amt_zscore,
                    got[k].card_tenure_days) == (0, 0, 0.0, 0.0)


@pytest.mark.parametrize("amounts", [
    [10002.34] * 300 + [10012.34],
    [10002.34 + (k % 3) * 1e-7 for k in range(300)] + [10002.35],
    [50.0 + (k * 37 % 100) / 10 for k in range(300)] + [None, 61.0],
])
def test_strategies_agree_on_any_spread(spark, amounts):
    """Constant, nearly constant and varied histories, and a null time: the split
    card gives what the one window gives (a mean of 10002.34 is known to 1e-12, and
    the z-score of a constant history divides that by 1e-6)."""
    rows = [(k, 1, 60 * k, a) for k, a in enumerate(amounts)] + [(9001, 1, None, 5.0), (9002, 2, None, 5.0)]
    df = spark.createDataFrame(rows, "txn_id long, card_id long, ts_sec long, amt double")
    one, split = ({r.txn_id: r for r in causal_features(df, strategy=s, num_partitions=8).collect()} for s in ("window", "skew"))
    assert set(one) == set(split) == {r[0] for r in rows}
    for k in one:
        assert (one[k].velocity_1h, one[k].velocity_24h) == (split[k].velocity_1h, split[k].velocity_24h)
        if one[k].amt_zscore is None:
            assert split[k].amt_zscore is None
        else:
            assert split[k].amt_zscore == pytest.approx(one[k].amt_zscore, rel=1e-5, abs=1e-4)
        assert split[k].card_tenure_days == pytest.approx(one[k].card_tenure_days)
    for k in (9001, 9002):
        assert (one[k].velocity_1h, one[k].velocity_24h, one[k].amt_zscore, one[k].card_tenure_days) == (0, 0, 0.0, 0.0)


def test_score_bins(spark):
    vals = [0.0, 0.2, 0.4, 0.6, 0.6000000000000001, 0.8, 1.0]
    df = spark.createDataFrame([(v,) for v in vals], "s double")
    got = [r[0] for r in df.select(S.score_bin("s")).collect()]
    assert got == [0, 1, 2, 2, 3, 4, 4]


def test_split_sizes(spark):
    assert split_sizes(10) == (8, 9)
    df = spark.range(10).select(F.col("id").alias("txn_id"), F.col("id").alias("ts_sec"))
    got = {r.txn_id: r.train_split for r in time_split(df).collect()}
    assert [got[i] for i in range(10)] == ["train"] * 8 + ["val", "test"]


def test_email(spark):
    df = spark.createDataFrame([(None, "x"), ("ProtonMail.com", "ProtonMail.com"),
                                ("gmail.com", "acme.com"), ("acme.com", None)], "p string, r string")
    got = df.select(S.email_group("p"), S.email_match("p", "r")).collect()
    assert [tuple(r) for r in got] == [("missing", -1.0), ("anonymous", 1.0),
                                       ("free", 0.0), ("corporate", -1.0)]


@pytest.mark.parametrize("inp,out", [
    ("x <explanation>\n hi\nyo \n</explanation> z", "hi\nyo"),
    ("<explanation> cut off", "cut off"),
    ("  bare ", "bare"),
])
def test_parse(spark, inp, out):
    df = spark.createDataFrame([(inp,)], "t string")
    assert df.select(X.parse_explanation("t")).first()[0] == out


def test_wrap_jaccard_cache_key(spark):
    df = spark.createDataFrame([("a", "a b", "b c", "", "")], "s string, a string, b string, e1 string, e2 string")
    r = df.select(X.wrap_explanation("s"), X.wrap_explanation(F.lit("<explanation>a")),
                  X.token_jaccard("a", "b"), X.token_jaccard("e1", "e2"),
                  X.token_jaccard("e1", "s"), X.cache_key(F.lit(7), "m")).first()
    assert r[0] == "<explanation>\na\n</explanation>"
    assert r[1] == "<explanation>a"
    assert r[2] == pytest.approx(1 / 3)
    assert (r[3], r[4]) == (1.0, 0.0)
    assert r[5] == "599a54b8fb7bdecb"


def test_completion_mask_and_mse(spark):
    df = spark.createDataFrame([([5, 9, 9],), ([5, 6, 7],), ([9, 9],)], "ids array<int>")
    got = [r[0] for r in df.select(V.completion_mask("ids", 9)).collect()]
    assert got == [[1, 1, 0], [1, 1, 1], [1, 0]]
    v = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0], [-1.0, 0.0])], "a array<double>, b array<double>, c array<double>")
    r = v.select(V.row_mse_nrm("a", "b"), V.row_mse_nrm("a", "c")).first()
    assert r[0] == pytest.approx(2.0, abs=1e-6) and r[1] == pytest.approx(4.0, abs=1e-6)
    assert math.isclose(v.select(V.cosine("a", "c")).first()[0], -1.0)


@pytest.mark.parametrize("d,plus", [(0, False), (1, True), (2, False), (3, True)])
def test_fixed_matches_python(spark, d, plus):
    vals = [0.125, 0.375, 2.5, 3.5, 0.15, 0.35, 1e7, -0.04, -0.0, 0.0, 102.5, -2.5, 99999.995, 12 / 7]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(R.fixed(F.col("x"), d, plus=plus)).collect()]
    spec = f"{{:{'+' if plus else ''}.{d}f}}"
    assert got == [spec.format(v) for v in vals]
