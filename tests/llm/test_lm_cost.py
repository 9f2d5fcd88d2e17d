"""The model's steps against their plain forms, and how many exponentials they take."""

import numpy as np
import pyarrow as pa
import pytest

from txnlens.llm import lm
from txnlens.llm.common import words_of


def model(words=700):
    return lm.Model(lm.Frequent([b"", *[b"w%d" % i for i in range(words - 1)]], 3_000_000 // np.arange(1, words + 1), words, 40_000_000, 2 * words))


def triples(net, rows, rng):
    """Counted triples, most of few words."""
    w2, w1, w = (rng.random((3, rows)) ** 3 * net.size).astype(np.int64)
    return np.unique((w2 * net.size + w1) * net.size + w, return_counts=True)


@pytest.fixture
def exponentials(monkeypatch):
    sizes, exp = [], np.exp
    monkeypatch.setattr(np, "exp", lambda x, *a, **kw: sizes.append(np.size(x)) or exp(x, *a, **kw))
    return sizes


def plain_sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def plain_ascend(x, squares, g):
    squares += g ** 2
    x += lm.RATE * g / (np.sqrt(squares) + 1e-4)


def plain_train(net, keys, counts, rng):
    """Training with dense gradients, every draw scored for itself."""
    k, p, n = net.size, net.p, lm.NOISE
    squares = {name: np.zeros_like(x) for name, x in p.items()}
    upto = np.concatenate([[0.0], np.cumsum(np.exp(net.log_block))])
    order = rng.permutation(len(keys))
    for at in range(0, len(order), lm.BATCH):
        some = order[at: at + lm.BATCH]
        t, weight = keys[some], counts[some] / counts[some].sum()
        w2, w1, w = t // (k * k), t // k % k, t % k
        block, h = w // lm.BLOCK, net.context(w2, w1)
        g = {name: np.zeros_like(x) for name, x in p.items()}
        drawn = np.minimum(np.searchsorted(upto, rng.random(lm.NOISE_DRAWS) * upto[-1], "right") - 1, net.blocks - 1)
        free = p["d"] - np.log(n) - net.log_block
        up = weight * (1 - plain_sigmoid((h * p["c"][block]).sum(1) + free[block]))
        down = plain_sigmoid(h @ p["c"][drawn].T + free[drawn]) * (weight * n / len(drawn))[:, None]
        dh = up[:, None] * p["c"][block] - down @ p["c"][drawn]
        np.add.at(g["c"], block, h * up[:, None])
        np.add.at(g["d"], block, up)
        np.subtract.at(g["c"], drawn, down.T @ h)
        np.subtract.at(g["d"], drawn, down.sum(0))
        lo = net.starts[block]
        hi = np.minimum(lo + lm.BLOCK, k)
        noise = np.searchsorted(net.upto, net.upto[lo][:, None] + rng.random((len(some), n)) * (net.upto[hi] - net.upto[lo])[:, None], "right") - 1
        noise = np.clip(noise, lo[:, None], hi[:, None] - 1)
        free = p["b"] - np.log(n) - net.log_own
        up = weight * (1 - plain_sigmoid((h * p["q"][w]).sum(1) + free[w]))
        down = plain_sigmoid((h[:, None] * p["q"][noise]).sum(2) + free[noise]) * weight[:, None]
        dh += up[:, None] * p["q"][w] - (down[:, :, None] * p["q"][noise]).sum(1)
        np.add.at(g["q"], w, h * up[:, None])
        np.add.at(g["b"], w, up)
        np.subtract.at(g["q"], noise, down[:, :, None] * h[:, None])
        np.subtract.at(g["b"], noise, down)
        np.add.at(g["r"], w1, dh * p["k"][0])
        np.add.at(g["r"], w2, dh * p["k"][1])
        g["k"] = np.stack([(dh * p["r"][w1]).sum(0), (dh * p["r"][w2]).sum(0)])
        for name in p:
            plain_ascend(p[name], squares[name], g[name])


def test_training_is_the_plain_one():
    net = model()
    plain, (keys, counts) = net.copy(), triples(net, 20_000, np.random.default_rng(4))
    net.train(keys, counts.astype(float), np.random.default_rng(5), {n: np.zeros_like(x) for n, x in net.p.items()})
    plain_train(plain, keys, counts.astype(float), np.random.default_rng(5))
    for name, x in net.p.items():
        assert np.allclose(x, plain.p[name], rtol=1e-9, atol=1e-11), name


def test_a_block_drawn_often_is_scored_once(exponentials):
    net = model()
    keys, counts = triples(net, 20_000, np.random.default_rng(4))
    exponentials.clear()
    net.train(keys, counts.astype(float), np.random.default_rng(5), {n: np.zeros_like(x) for n, x in net.p.items()})
    assert len(net.starts) == 3
    assert sum(exponentials) <= len(keys) * (2 + lm.NOISE + 3) + 10 * net.size


def test_normalisers_are_shared(exponentials):
    """Every word behind one context: one normaliser of the blocks and one for each block."""
    net = model()
    w = np.arange(net.size)
    exponentials.clear()
    got = net.log_prob(w * 0 + 2, w * 0 + 3, w)
    assert sum(exponentials) == net.blocks + net.size
    assert np.exp(got).sum() == pytest.approx(1, rel=1e-4)


@pytest.mark.parametrize("size", [1, 400])
def test_scores_of_small_and_large_parameters(size):
    net, rng = model(), np.random.default_rng(6)
    net.p["q"] *= size
    net.p["c"] *= size
    net.p["b"] += size * 3
    w2, w1, w = rng.integers(0, net.size, (3, 3000))
    want = np.empty(len(w))
    h = net.context(w2, w1)
    top = h @ net.p["c"].T + net.p["d"]
    full = h @ net.p["q"].T + net.p["b"]
    for i, x in enumerate(w.tolist()):
        lo = x // lm.BLOCK * lm.BLOCK
        s = full[i, lo: lo + lm.BLOCK]
        want[i] = sum(y[j] - y.max() - np.log(np.exp(y - y.max()).sum()) for y, j in ((top[i], x // lm.BLOCK), (s, x - lo)))
    assert np.allclose(net.log_prob(w2, w1, w), want, rtol=1e-4, atol=2e-3 if size > 1 else 1e-4)


def test_noise_is_the_searched_one():
    net, rng = model(2000), np.random.default_rng(7)
    block = rng.integers(0, net.blocks, 50_000)
    u = rng.random((len(block), 3))
    u[:100] = 0
    u[100:200] = np.nextafter(1, 0)
    lo = net.starts[block]
    hi = np.minimum(lo + lm.BLOCK, net.size)
    want = np.searchsorted(net.upto, net.upto[lo][:, None] + u * (net.upto[hi] - net.upto[lo])[:, None], "right") - 1
    assert (lm.Noise(net)(block, u) == np.clip(want, lo[:, None], hi[:, None] - 1)).all()


def test_tokens_are_the_words_and_an_end():
    rng = np.random.default_rng(8)
    pieces = np.array(["a", "B", "Zz", " ", "\t", "\n", "\x0b", "\x0c", "\r", "\x00", "\x1c", "\x1f", "\x85", "\xa0", "é", "É", "　", "😀"])
    texts = [None, "", " ", " a ", *("".join(rng.choice(pieces, n)) for n in rng.integers(0, 12, 3000))]
    for column in (pa.array(texts, pa.string()), pa.array(["cut off", *texts]).slice(1)):
        tokens, number, sizes = lm.tokens_of(column)
        want = [[*words_of(t), lm.END] for t in texts]
        assert [tokens[i] for i in number.tolist()] == [w for d in want for w in d]
        assert sizes.tolist() == [len(d) for d in want] and len(set(tokens)) == len(tokens)
    assert [len(x) for x in lm.tokens_of(pa.array([], pa.string()))] == [1, 0, 0]
