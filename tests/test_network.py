"""The network fit: gradients, falling loss, early stopping, no dependence on partitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnlens.operators import models as MD
from txnlens.operators import network as NW

NUMS = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    """A label that no linear score separates (the product of two signs), and an id
    that turns it around."""
    u = lambda k: F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(2000)) / 1000.0 - 1.0
    df = spark.range(3000).select(F.col("id").alias("k"), u(1).alias("a"), u(2).alias("b"), F.pmod("id", F.lit(3)).cast("int").alias("c"))
    y = (F.col("a") * F.col("b") > 0) != (F.col("c") == 2)
    split = F.when(F.pmod("k", F.lit(10)) < 7, "train").when(F.pmod("k", F.lit(10)) < 9, "val").otherwise("test")
    return df.withColumn("y", y.cast("int")).withColumn("train_split", split)


def test_erf_to_double_precision():
    x = np.concatenate([np.linspace(-8, 8, 20_001), [0.0, 1e-300, 6.0, np.inf, -np.inf]])
    assert np.abs(MD._erf(x) - [math.erf(v) for v in x]).max() < 1e-15


def test_gradient_matches_differences():
    rng = np.random.default_rng(1)
    net = NW.Network.begun({"c": 3, "d": 9}, 2, (5, 4), 0)
    ids, nums, y = {"c": rng.integers(0, 3, 20), "d": rng.integers(0, 9, 20)}, rng.normal(size=(20, 2)), rng.integers(0, 2, 20).astype(float)
    at = net.flat()
    loss, g = net.gradient(ids, nums, y, 2.5)
    z = net.logits(net.inputs(ids, nums))
    assert loss == pytest.approx((np.where(y > 0, 2.5 * np.log1p(np.exp(-z)), np.log1p(np.exp(z)))).sum())
    for k in rng.choice(at.size, 40, replace=False):
        e = np.zeros_like(at)
        e[k] = 1e-6
        up, down = (net.like(at + s * e).gradient(ids, nums, y, 2.5)[0] for s in (1, -1))
        assert g[k] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_one_erf_a_layer_and_all_rows_of_an_id(monkeypatch):
    net = NW.Network.begun({"c": 4}, 1, (5, 4), 0)
    ids, nums, y = {"c": np.array([0, 3, 3, 0, 3])}, np.linspace(-1, 1, 5)[:, None], np.array([0.0, 1, 1, 0, 0])
    calls, erf = [], MD._erf
    monkeypatch.setattr(MD, "_erf", lambda x: calls.append(x.shape) or erf(x))
    whole = net.gradient(ids, nums, y, 2.0)[1]
    assert calls == [(5, 5), (5, 4)]
    single = sum(net.gradient({"c": ids["c"][k: k + 1]}, nums[k: k + 1], y[k: k + 1], 2.0)[1] for k in range(5))
    assert np.abs(whole - single).max() < 1e-12
    assert np.array_equal(MD.gelu_grad(nums), MD.gelu_both(nums)[1]) and np.allclose(MD.gelu(nums), MD.gelu_both(nums)[0], rtol=0, atol=1e-16)


def test_loss_falls_and_the_network_learns(spark, rows):
    fit = NW.train_network(rows.repartition(4), "k", {"c": 3}, NUMS, "y", hidden=(16, 8), epochs=12, step=0.03, patience=12, decay=0.0)
    losses = [h["loss"] for h in fit.history]
    assert all(b < a for a, b in zip(losses, losses[1:]))
    assert fit.history[fit.best_epoch - 1]["val_auc"] == max(h["val_auc"] for h in fit.history)


def test_batches_learn_what_no_line_separates(spark, rows):
    fit = NW.train_network(rows, "k", {"c": 3}, NUMS, "y", hidden=(16, 8), epochs=10, batches=4, step=0.05, patience=10, decay=0.0)
    assert max(h["val_auc"] for h in fit.history) > 0.9
    forward = MD.mlp_forward(rows, "k", NUMS, fit.network.layers, 0, ["c"], fit.network.embeddings)
    both = forward.join(NW.scored(rows, fit.network, NUMS, ["k"]), "k").agg(F.max(F.abs(F.col("fraud_score") - F.col("score")))).first()[0]
    assert both < 1e-12  # the scoring operator takes the trained tables as they are


def test_same_result_however_rows_are_dealt(spark, rows):
    few = rows.where("k < 600")
    a, b = (NW.train_network(few.repartition(n), "k", {"c": 3}, NUMS, "y", hidden=(6,), epochs=3, batches=2, step=0.02).network.flat() for n in (1, 7))
    assert np.abs(a - b).max() < 1e-6


def test_early_stop_and_step_size(spark, rows, monkeypatch):
    aucs = iter([0.6, 0.7, 0.7, 0.65, 0.7, 0.7, 0.9])
    monkeypatch.setattr(NW.M, "auc_roc", lambda *a: type("R", (), {"first": lambda self: {"auc_roc": next(aucs)}})())
    fit = NW.train_network(rows.where("k < 100"), "k", {"c": 3}, NUMS, "y", hidden=(3,), epochs=9, patience=4)
    assert fit.best_epoch == 2 and len(fit.history) == 6
    assert [h["step"] for h in fit.history] == [1e-3] * 5 + [5e-4]


def test_nulls_and_missing_classes(spark):
    rows = spark.createDataFrame([(k, None if k % 3 else 1.0, 0.5, None if k % 5 == 0 else k, None if k == 2 else 0, "train" if k % 2 else "val") for k in range(20)],
                                 "k long, a double, b double, c int, y int, train_split string")
    fit = NW.train_network(rows, "k", {"c": 4}, NUMS, "y", hidden=(3,), epochs=2)
    assert fit.best_epoch == 2 and all(h["val_auc"] is None for h in fit.history)
    assert np.isfinite(fit.network.flat()).all()
    empty = NW.train_network(rows.limit(0), "k", {"c": 4}, NUMS, "y", hidden=(3,), epochs=1)
    assert empty.history[0]["loss"] is None
