"""Scores against a plain loop over tokens from the fitted parameters; gradients; how the
model's words are chosen."""

import math

import numpy as np
import pytest
from conftest import SF001
from pyspark.sql import functions as F

from txnlens.llm import lm
from txnlens.llm.common import table, words_of


def test_scores_follow_from_the_parameters(spark):
    docs = table(spark, SF001, "documents").select("doc_id", "text").repartition(3, "doc_id").cache()
    counts, top, net = lm.fit_lm(docs)
    assert len(net.starts) > 1
    got = {r.doc_id: r.score for r in lm.lm_scores(docs).collect()}
    c = {bytes(r.token): r.c for r in counts.collect()}
    kind = {t: i + 1 for i, t in enumerate(top.tokens[: top.words])}
    p = {n: x.tolist() for n, x in net.p.items()}
    rest = top.n - sum(top.counts[: top.words].tolist()) + top.v - top.words + 1

    def log_softmax(scores, own):
        high = max(scores)
        return scores[own] - high - math.log(sum(math.exp(s - high) for s in scores))

    def dot(x, y):
        return sum(a * b for a, b in zip(x, y))

    some = docs.orderBy(F.length("text"), "doc_id").limit(50).collect()
    assert len(some) == 50
    for d in some:
        w2 = w1 = 1
        total = 0.0
        for token in [*words_of(d.text), b""]:
            w = kind.get(token, 0)
            h = [p["r"][w1][i] * p["k"][0][i] + p["r"][w2][i] * p["k"][1][i] for i in range(lm.DIM)]
            block, lo = w // lm.BLOCK, w // lm.BLOCK * lm.BLOCK
            hi = min(lo + lm.BLOCK, net.size)
            total += log_softmax([dot(h, x) + y for x, y in zip(p["c"], p["d"])], block) / math.log(10)
            total += log_softmax([dot(h, p["q"][j]) + p["b"][j] for j in range(lo, hi)], w - lo) / math.log(10)
            if not w:
                total += math.log10((c.get(token, 0) + 1) / rest)
            w2, w1 = w1, w
        assert got[d.doc_id] == pytest.approx(total, rel=1e-4, abs=1e-4)


def test_untrained_model_is_the_unigram_share():
    top = lm.Frequent([b"", *[b"w%d" % i for i in range(600)]], np.arange(700, 99, -1), 601, 300_000, 900)
    net = lm.Model(top)
    net.p["q"][:] = net.p["c"][:] = 0
    share = (net.counts + 1) / (net.counts + 1).sum()
    w = np.arange(net.size)
    assert np.allclose(np.exp(net.log_prob(w * 0 + 1, w * 0 + 1, w)), share, rtol=1e-3)


def test_gradient_of_the_contexts(monkeypatch):
    """dh is the derivative of the objective that a step climbs."""
    monkeypatch.setattr(lm, "BLOCK", 4)
    top = lm.Frequent([b"", *[b"%d" % i for i in range(9)]], np.arange(30, 20, -1), 10, 300, 40)
    net, rng = lm.Model(top), np.random.default_rng(3)
    h, target = rng.standard_normal((5, lm.DIM)), np.array([0, 3, 7, 9, 10])
    noise, weight = rng.integers(0, 11, (5, lm.NOISE)), rng.random(5)
    before = net.copy()
    dh = net.step(h, target, noise, weight, "q", "b", net.log_own, {n: np.zeros_like(x) for n, x in net.p.items()})

    def objective(h):
        q, b, ln = before.p["q"], before.p["b"], np.log(lm.NOISE) + net.log_own
        good = np.log(lm.sigmoid((h * q[target]).sum(1) + b[target] - ln[target]))
        bad = np.log(1 - lm.sigmoid(np.einsum("nd,nkd->nk", h, q[noise]) + b[noise] - ln[noise])).sum(1)
        return (weight * (good + bad)).sum()

    for i, j in ((0, 0), (2, 5), (4, 15)):
        step = np.zeros_like(h)
        step[i, j] = 1e-5
        assert (objective(h + step) - objective(h - step)) / 2e-5 == pytest.approx(dh[i, j], rel=1e-4, abs=1e-8)


def test_tied_counts_fill_the_memo(spark):
    counts = spark.createDataFrame([(bytearray(b"t%d" % i), 7) for i in range(3000)] + [(bytearray(b"top"), 90), (bytearray(b""), 5)], "token binary, c long")
    top = lm.Frequent.of(counts, memo=1000)
    assert 900 <= len(top.tokens) <= 1001 and top.tokens[:2] == [b"", b"top"] and top.words == len(top.tokens)
    assert (top.n, top.v) == (21_095, 3002)
    assert len(lm.Frequent.of(counts, memo=4000).tokens) == 3002


def test_words_grow_with_the_corpus(spark):
    def words(n):
        rows = [(i, " ".join(f"w{j}" for j in range(i % n, i % n + 20))) for i in range(5 * n)]
        return lm.fit_lm(spark.createDataFrame(rows, "doc_id long, text string"))[1].words
    assert words(40) < words(80) < words(160)


def test_long_text_and_clashing_columns(spark):
    text = "Alpha beta gamma " * 400_000
    df = spark.createDataFrame([(1, text, "x", 3.0), (2, "alpha", None, 1.0), (2, "alpha", None, 1.0)], "doc_id long, text string, token string, score double")
    rows = lm.lm_scores(df).orderBy("n_tokens").collect()
    assert [r.n_tokens for r in rows] == [2, 2, 1_200_001] and rows[0].score == rows[1].score
    assert all(np.isfinite(r.score) and r.score <= 0 for r in rows)
