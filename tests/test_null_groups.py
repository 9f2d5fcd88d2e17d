"""Null groups, null scores and wide vectors give what the plain sums give."""

import numpy as np
import pytest

from txnlens.operators import geometry as G
from txnlens.operators import metrics as M
from txnlens.operators import sampling as SM


@pytest.fixture()
def pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(k, None if k % 3 == 0 else "g" if k % 3 == 1 else "h", rng.normal(size=6).tolist(), rng.normal(size=6).tolist()) for k in range(60)]
    return spark.createDataFrame(rows, "k long, g string, p array<double>, v array<double>")


@pytest.mark.parametrize("rollup", [False, True])
def test_wide_and_narrow_fve_agree(pairs, monkeypatch, rollup):
    def report():
        return sorted(((str(r.g), r.n, round(r.mse_nrm, 9), round(r.fve_nrm, 9)) for r in M.fve(pairs, "p", "v", by=["g"], rollup=rollup).collect()))
    narrow = report()
    monkeypatch.setattr(M, "WIDE_AGG_MAX_DIM", 2)
    assert report() == narrow and len(narrow) == 3 + rollup


def test_vector_mean_keeps_the_null_group(pairs, monkeypatch):
    def means():
        return {str(r.g): [round(x, 9) for x in r.mean_vector] for r in M.vector_mean(pairs, "v", by=["g"]).collect()}
    narrow = means()
    monkeypatch.setattr(M, "WIDE_AGG_MAX_DIM", 2)
    assert means() == narrow and set(narrow) == {"None", "g", "h"}


def test_quantiles_keep_the_null_group(pairs):
    got = {r.g: (r.n, r.cos_median) for r in M.cosine_summary(pairs, "p", "v", by=["g"], key="k").collect()}
    assert {k: n for k, (n, _) in got.items()} == {None: 20, "g": 20, "h": 20}


def test_null_scores_are_counted(spark):
    df = spark.createDataFrame([(0.9, 1), (0.2, 0), (None, 1), (0.1, 0)], "s double, y int")
    r = M.auc_ap(df, "s", "y").first()
    assert (r.n_pos, r.n_neg, r.auc_roc) == (2, 2, 0.5)


def test_one_row_has_no_derangement(spark):
    with pytest.raises(ValueError):
        SM.derange(spark.range(1).withColumnRenamed("id", "k"), "k", 1)


@pytest.mark.parametrize("d", [3, 700])
def test_moments_in_blocks(spark, d):
    x = np.random.default_rng(d).normal(size=(40, d))
    df = spark.createDataFrame([(r.tolist(), (r[::-1]).tolist()) for r in x], "a array<double>, b array<double>").repartition(3)
    m = G.moment_sums(df, ["a", "b"], cross=[("a", "b")])
    assert m["n"] == 40 and np.allclose(m["G"]["a"], x.T @ x) and np.allclose(m["C"][("a", "b")], x.T @ x[:, ::-1])
    assert m["C2"][("a", "b")] == pytest.approx(((x.T @ x[:, ::-1]) ** 2).sum()) and np.allclose(m["S"]["b"], x[:, ::-1].sum(0))


def test_water_fill_levels():
    assert SM.water_fill({"a": 2, "b": 100, "c": 100}, 50) == {"a": 2, "b": 24, "c": 24}
    assert SM.water_fill({"a": 5, "b": 5, "c": 5}, 5) == {"a": 2, "b": 2, "c": 1}
    assert SM.water_fill({"a": 1, "b": 9}, 100) == {"a": 1, "b": 9}
    assert SM.water_fill({"a": 4, "b": 9}, 6, min_per_cell=5) == {"a": 4, "b": 2}
