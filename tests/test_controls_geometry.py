import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF01
from txnlens.operators import controls as C
from txnlens.operators import geometry as G
from txnlens.sources import tables as T


@pytest.mark.parametrize("real,swap,floor,want", [
    (0.431, -0.867, -0.340, "PASS"),
    (0.40, 0.38, -0.34, "FAIL"),
    (0.40, 0.10, -0.34, "AMBIGUOUS"),
])
def test_verdict(spark, real, swap, floor, want):
    df = spark.createDataFrame([(real, swap, floor)], "r double, s double, f double")
    assert df.select(C.verdict(F.col("r"), F.col("s"), F.col("f"))).first()[0] == want


def test_effective_rank_identity(spark):
    d = 6
    rows = [([1.0 if i == j else 0.0 for j in range(d)],) for i in range(d)]
    df = spark.createDataFrame(rows, "v array<double>")
    r = G.effective_rank(df, "v")
    assert r["effective_rank"] == pytest.approx(d)
    assert r["n_components_99"] == d


def test_pair_stats_match_bruteforce(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 5))
    y = x @ rng.normal(size=(5, 3)) + 0.1 * rng.normal(size=(40, 3))
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)],
                               "a array<double>, b array<double>")
    rep = G.pairwise_report(df, "a", "b")
    un = lambda m: m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-12)
    iu = np.triu_indices(40, 1)
    ci, co = (un(x) @ un(x).T)[iu], (un(y) @ un(y).T)[iu]
    assert rep["in_mean"] == pytest.approx(ci.mean())
    assert rep["in_std"] == pytest.approx(ci.std())
    assert rep["out_std"] == pytest.approx(co.std())
    assert rep["pearson_r"] == pytest.approx(np.corrcoef(ci, co)[0, 1])


def test_projection_norm(spark):
    a = T.act(spark, SF01)
    w = G.pca_components(a, "activation_vector", 4)
    p = G.project(a, "activation_vector", w, None, 3.0)
    r = G.norm_check(p, "projected").first()
    assert r["norm_mean"] == pytest.approx(3.0, rel=1e-6)


def test_wide_paths_match(spark, monkeypatch):
    from txnlens.operators import metrics as M
    a = T.recon(spark, SF01)
    narrow = M.fve(a, "pred_vector", "activation_vector", by=["label"]).collect()
    mean_n = M.vector_mean(a, "activation_vector", by=["label"]).collect()
    monkeypatch.setattr(M, "WIDE_AGG_MAX_DIM", 8)
    wide = M.fve(a, "pred_vector", "activation_vector", by=["label"]).collect()
    mean_w = M.vector_mean(a, "activation_vector", by=["label"]).collect()
    key = lambda r: r["label"]
    for x, y in zip(sorted(narrow, key=key), sorted(wide, key=key)):
        assert x.fve_nrm == pytest.approx(y.fve_nrm, rel=1e-9)
    for x, y in zip(sorted(mean_n, key=key), sorted(mean_w, key=key)):
        assert np.allclose(x.mean_vector, y.mean_vector)
    w = G.pca_components(T.act(spark, SF01), "activation_vector", 4)
    p1 = G.project(T.act(spark, SF01), "activation_vector", w, None, 3.0)
    monkeypatch.setattr(G, "INLINE_MAX_COEFS", 1)
    p2 = G.project(T.act(spark, SF01), "activation_vector", w, None, 3.0)
    d1 = {r.row_idx: r.projected for r in p1.collect()}
    d2 = {r.row_idx: r.projected for r in p2.collect()}
    assert all(np.allclose(d1[k], d2[k]) for k in d1)


def test_mlp_gradient_matches_finite_differences():
    from txnlens.operators import models as MD
    rng = np.random.default_rng(3)
    ws = [(rng.normal(size=(6, 5)), rng.normal(size=6)), (rng.normal(size=(4, 6)), rng.normal(size=4)),
          (rng.normal(size=(1, 4)), rng.normal(size=1))]
    x = rng.normal(size=(3, 5))
    logit, cap, grad = MD.forward_backward(x, ws, capture=1, n_num=3)
    assert cap.shape == (3, 4)
    eps = 1e-6
    for j in range(3):
        xp, xm = x.copy(), x.copy()
        xp[:, 2 + j] += eps
        xm[:, 2 + j] -= eps
        fd = (MD.forward_backward(xp, ws, 1, 3)[0] - MD.forward_backward(xm, ws, 1, 3)[0]) / (2 * eps)
        assert np.allclose(grad[:, j], fd, atol=1e-5)
    assert MD.embedding_dim(3) == 2 and MD.embedding_dim(10) == 5 and MD.embedding_dim(500) == 8
