"""Order statistics of products that are never stored, against all of them stored."""

import numpy as np
import pytest

from txnlens.operators import pair_order as PO

SCHEMA = "row_idx long, a array<double>, b array<float>"


def table(spark, a, b, parts=3):
    return spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(zip(a, b))], SCHEMA).repartition(parts)


def vectors(n, d=6, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n, d))
    if copies:
        a[rng.integers(0, n, copies)] = a[0]
    b = (0.7 * a + 0.3 * rng.normal(size=(n, d))).astype(np.float32)
    return a.tolist(), b.tolist()


def cosines(rows):
    m = np.array(rows, np.float64)
    u = m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-12)
    return (u @ u.T)[np.triu_indices(len(m), 1)]


def mid_ranks(x):
    x = np.round(x, 12)  # equal cosines differ in the last bits
    _, which, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[which]


def check(rep, a, b, tol=1e-9):
    for side, c in (("in_", cosines(a)), ("out_", cosines(b))):
        want = {"mean": c.mean(), "std": c.std(), "median": np.median(c), "p5": np.percentile(c, 5), "p95": np.percentile(c, 95)}
        assert {k: rep[side + k] for k in want} == pytest.approx(want, abs=1e-9)
    assert rep["spearman_r"] == pytest.approx(np.corrcoef(mid_ranks(cosines(a)), mid_ranks(cosines(b)))[0, 1], abs=tol)
    assert rep["n_pairs"] == len(cosines(a))


def test_blocks_meet_once(spark, monkeypatch):
    monkeypatch.setattr(PO, "BLOCK_ROWS", 20)
    a, b = vectors(130)
    rep = PO.pair_order_report(table(spark, a, b), "row_idx", "a", "b")
    check(rep, a, b)
    assert rep["rank_resolution"] == 0


def test_ties(spark):
    """A third of the rows are one vector: thousands of equal cosines."""
    a, b = vectors(90, copies=30, seed=2)
    a, b = [np.round(x).tolist() for x in a], [np.round(x).tolist() for x in b]
    check(PO.pair_order_report(table(spark, a, b), "row_idx", "a", "b"), a, b, 1e-6)


def test_coarse_ranks_are_within_their_bound(spark, monkeypatch):
    monkeypatch.setattr(PO, "EXACT", 10)
    monkeypatch.setattr(PO, "RESOLUTION", 50)
    a, b = vectors(80, seed=3)
    rep = PO.pair_order_report(table(spark, a, b), "row_idx", "a", "b")
    assert 0 < rep["rank_resolution"] <= 1 / 50 + 1e-3
    check(rep, a, b, 1e-3)


def test_few_rows_and_missing_vectors(spark):
    a, b = vectors(3, seed=4)
    df = table(spark, a, b)
    rest = spark.createDataFrame([(10, None, [1.0]), (11, [1.0, None], [1.0]), (12, [1.0, 2.0], [1.0])], SCHEMA)
    check(PO.pair_order_report(df.unionAll(rest), "row_idx", "a", "b"), a, b)
    for n in (0, 1):
        rep = PO.pair_order_report(df.limit(n), "row_idx", "a", "b")
        assert rep["n_pairs"] == 0 and rep["in_median"] is None and rep["spearman_r"] is None
    same = table(spark, [[1.0, 2.0]] * 4, [[1.0, 2.0]] * 4)
    rep = PO.pair_order_report(same, "row_idx", "a", "b")
    assert rep["in_median"] == pytest.approx(1) and rep["spearman_r"] is None  # one value has no ranks


def test_reference_rows(spark):
    a, b = vectors(200, seed=5)
    df = table(spark, a, b)
    block = PO.reference_rows(df, "row_idx", "a", 40, 11)
    assert block.shape == (40, 6) and {tuple(x) for x in block} <= {tuple(x) for x in a}
    own = PO.reference_cosines(df, "b", block).ordered(list(PO.QUANTILES.values()))["cos"]
    u, r = (np.array(x, np.float64) / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12) for x in (b, block))
    c = (u @ r.T).ravel()
    rep = PO.order_block(own, "")
    assert [rep[k] for k in ("mean", "std", "median", "p5", "p95")] == pytest.approx([c.mean(), c.std(), np.median(c), *np.percentile(c, [5, 95])])


def test_no_row_a_pair(spark, monkeypatch):
    """Work travels as packed blocks: n rows give n * n / BLOCK_ROWS ** 2 meetings."""
    monkeypatch.setattr(PO, "BLOCK_ROWS", 25)
    a, b = vectors(100, seed=6)
    rows = []

    class Rows:
        def __init__(self):
            self.n = 0

        def add(self, values):
            self.n += sum(v.size for v in values.values())

        def rows(self):
            yield {"n": self.n}

    products = PO.pair_cosines(table(spark, a, b), "row_idx", {"in": "a"})
    out = products._each(Rows, "n long")
    rows = [r.n for r in out.collect()]
    assert sum(rows) == 4950 and len(rows) <= 10
    plan = out._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_cells_merge_like_counts():
    rng = np.random.default_rng(7)
    v, edges = rng.normal(size=500), np.linspace(-1, 1, 9)
    whole = PO.counted(v, edges)
    parts = PO.merged(PO.merged(PO.counted(v[:100], edges), PO.counted(v[100:101], edges)), PO.counted(v[101:], edges))
    assert (whole == parts).all() and whole["count"].sum() == 500
