"""Steering through the network's tail."""

import numpy as np
import pytest

from txnlens.operators import evals as EV
from txnlens.operators import models as MD


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(3)
    layers = [(rng.normal(size=(d, k)), rng.normal(size=d)) for k, d in ((4, 6), (6, 5), (5, 1))]
    x = rng.normal(size=(50, 4))
    rows = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "k long, a double, b double, c double, d double").repartition(3)
    return layers, x, MD.mlp_forward(rows, "k", list("abcd"), layers, capture=0)


def test_alpha_zero_is_the_full_forward_pass(case):
    layers, x, captured = case
    out = {r.alpha: r for r in EV.network_steering(captured, "activation_vector", {"u": [1.0] * 6}, [0.0, 1.0], layers[1:]).collect()}
    logit, _, _ = MD.forward_backward(x, layers, 0, 4)
    assert out[0.0].n == 50 and out[0.0].mean_shift == 0 and out[0.0].share_lower == 0
    assert out[0.0].mean_score == pytest.approx((1 / (1 + np.exp(-logit))).mean(), abs=1e-6)  # captured as floats
    assert out[1.0].mean_shift != 0


def test_directions_and_alphas(case):
    layers, _, captured = case
    h = np.array([r.activation_vector for r in captured.collect()], np.float64)
    directions = {"p": [1.0, 2, 3, 4, 5, 6], "q": [0.0, 0, 0, 0, 0, -2]}
    got = {(r.direction, r.alpha): r for r in EV.network_steering(captured, "activation_vector", directions, [0.5, -2.0], layers[1:]).collect()}
    own = EV.tail_scores(h, layers[1:])
    for name, d in directions.items():
        for a in (0.5, -2.0):
            s = EV.tail_scores(h + a * np.linalg.norm(h, axis=1, keepdims=True) * np.array(d) / np.linalg.norm(d), layers[1:])
            r = got[name, a]
            assert (r.mean_score, r.mean_shift, r.share_lower) == pytest.approx((s.mean(), (s - own).mean(), (s < own).mean()), abs=1e-9)


def test_no_rows(case):
    layers, _, captured = case
    assert EV.network_steering(captured.limit(0), "activation_vector", {"u": [1.0] * 6}, [0.0], layers[1:]).count() == 0
