"""Pairs of tokens by their merge trees, against the merges themselves."""

import random

import pytest

from txnlens.llm import bpe
from txnlens.llm.queries import BYTE_BPE, WORD_BPE


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_pairs_that_stay_apart(path):
    m = bpe.StreamEncoder(path).merges
    assert m.rising
    rng, apart = random.Random(1), 0
    common = list(range(min(3000, len(m.names))))
    for _ in range(6000):
        a, b = rng.choice(common), rng.choice(common)
        if m.suffix and m.symbols[m.names[a]] < len(m.names[a]):
            continue  # a last symbol has nothing behind it
        want = m.merged(m.spelled(m.names[a]) + m.spelled(m.names[b])) == [m.names[a], m.names[b]]
        assert m.fits(a, b) == want, (m.names[a], m.names[b])
        apart += want
    assert apart > 500


def made_up(seed):
    """A small trained-looking list over two letters: equal parts, overlaps, ties of place."""
    rng = random.Random(seed)
    tokens, merges = ["a", "b"], []
    while len(merges) < 12:
        pair = (rng.choice(tokens), rng.choice(tokens))
        if pair not in merges and "".join(pair) not in tokens:
            merges.append(pair)
            tokens.append("".join(pair))
    return tokens, merges


@pytest.mark.parametrize("seed", range(30))
def test_small_lists_with_overlapping_merges(seed):
    tokens, merges = made_up(seed)
    m = bpe.Merges({t: k for k, t in enumerate(tokens)}, merges)
    rng = random.Random(seed)
    for _ in range(300):
        word = "".join(rng.choice("aab") for _ in range(rng.randint(0, 40)))
        want = [tokens.index(t) for t in m.merged(list(word))]
        assert list(m.stream(word)) == want, word
        assert list(m.stream(iter(word))) == want, word


def test_symbols_that_no_token_spells():
    tokens, merges = made_up(3)
    m = bpe.Merges({t: k for k, t in enumerate(tokens)}, merges)
    assert list(m.stream("xaxxbx")) == [0, 1] and list(m.stream("")) == [] and list(m.stream("x")) == []


def test_a_list_that_does_not_rise():
    """A pair made late merges early: the trees cannot be used, the merges are run."""
    tokens = ["a", "b", "c", "bc", "ab", "abc"]
    m = bpe.Merges({t: k for k, t in enumerate(tokens)}, [("a", "bc"), ("b", "c"), ("a", "b")])
    assert not m.rising
    for word in ("abc", "aabcbc", "bcabcab"):
        assert list(m.stream(word)) == [tokens.index(t) for t in m.merged(list(word))]
