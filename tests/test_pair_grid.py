"""Pair products counted on a grid: few passes, whatever the cosines are like."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnlens.operators import pair_order as PO

SCHEMA = "row_idx long, a array<double>, b array<double>"


def table(spark, a, b):
    return spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(zip(a.tolist(), b.tolist()))], SCHEMA).repartition(3)


def cosines(m):
    u = m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-12)
    return np.round((u @ u.T)[np.triu_indices(len(m), 1)], 12)


def mid_ranks(x):
    _, which, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[which]


def check(rep, a, b, tol):
    x, y = cosines(a), cosines(b)
    for side, c in (("in_", x), ("out_", y)):
        want = {"mean": c.mean(), "std": c.std(), "median": np.median(c), "p5": np.percentile(c, 5), "p95": np.percentile(c, 95)}
        assert {k: rep[side + k] for k in want} == pytest.approx(want, abs=1e-9)
    assert rep["n_pairs"] == len(x)
    assert rep["spearman_r"] == pytest.approx(np.corrcoef(mid_ranks(x), mid_ranks(y))[0, 1], abs=tol)


@pytest.fixture
def passes(monkeypatch):
    """The schemas of the passes over all pairs."""
    seen = []
    make = PO.Products.__init__

    def init(self, df, names, each):
        make(self, df, names, lambda sink, schema: seen.append(schema) or each(sink, schema))

    monkeypatch.setattr(PO.Products, "__init__", init)
    return seen


def spread(n=300, d=16, near=0.0, seed=5):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n, d)) * (near or 1.0) + (1.0 if near else 0.0)
    return a, 0.7 * a + 0.3 * np.roll(a, 1, axis=0)


def test_two_passes_over_all_pairs(spark, monkeypatch, passes):
    """One counts, one narrows the quantiles and adds up the ranks."""
    monkeypatch.setattr(PO, "EXACT", 1000)
    monkeypatch.setattr(PO, "RESOLUTION", 1000)
    a, b = spread()
    rep = PO.pair_order_report(table(spark, a, b), "row_idx", "a", "b")
    check(rep, a, b, 1e-5)
    assert 0 < rep["rank_resolution"] <= 1e-3
    assert len(passes) == 2


def test_cosines_in_a_few_cells(spark, monkeypatch, passes):
    """All pairs within some thousand cells: those are split before ranks are taken."""
    monkeypatch.setattr(PO, "EXACT", 1000)
    monkeypatch.setattr(PO, "RESOLUTION", 1 << 13)
    a, b = spread(near=0.005)
    assert np.ptp(cosines(a)) < 5e-4
    rep = PO.pair_order_report(table(spark, a, b), "row_idx", "a", "b")
    check(rep, a, b, 1e-6)
    assert rep["rank_resolution"] <= 2 / (1 << 13)
    assert len(passes) <= 5


def test_ties_beyond_the_exact_size(spark, monkeypatch):
    """A few hundred values of thousands of pairs each keep their mid-ranks."""
    monkeypatch.setattr(PO, "EXACT", 1000)
    rng = np.random.default_rng(9)
    a = rng.integers(0, 2, (250, 6)).astype(float)
    b = np.where(rng.random(a.shape) < 0.2, 1 - a, a)
    rep = PO.pair_order_report(table(spark, a, b), "row_idx", "a", "b")
    check(rep, a, b, 1e-9)
    assert rep["rank_resolution"] == 0


def test_missing_numbers_are_the_greatest(spark, monkeypatch):
    monkeypatch.setattr(PO, "EXACT", 1000)
    a, b = spread(n=100)
    a[3, 2] = math.nan
    rep = PO.pair_order_report(table(spark, a, b), "row_idx", "a", "b")
    c = np.sort(cosines(a))  # NaN come last
    assert rep["n_pairs"] == 4950 and math.isnan(rep["in_mean"])
    assert rep["in_p5"] == pytest.approx(np.interp(0.05 * 4949, np.arange(4950), c), abs=1e-9)


def test_a_task_a_group(spark, monkeypatch):
    """No two groups of parts wait for each other in one task."""
    monkeypatch.setattr(PO, "BLOCK_ROWS", 10)
    a, b = spread(n=200)

    class Values:
        def __init__(self):
            self.n = 0

        def add(self, values):
            self.n += sum(v.size for v in values.values())

        def rows(self):
            yield {"n": self.n}

    out = PO.pair_cosines(table(spark, a, b), "row_idx", {"c": "a"})._each(Values, "n long")
    rows = out.select("n", F.spark_partition_id().alias("task")).collect()
    assert sum(r["n"] for r in rows) == 19900
    assert out.rdd.getNumPartitions() == len(rows) == len({r["task"] for r in rows}) == 10


def test_grid_bins_are_in_order():
    rng = np.random.default_rng(2)
    values = np.sort(np.concatenate([np.rint(rng.uniform(-1, 1, 4000) * PO.UNIT), [-PO.UNIT, 0, PO.UNIT], 5e9 + np.arange(300.0) * 7]))
    plain = PO.Grid()
    counter = PO.GridCounter({"c": plain})
    counter.add({"c": values.copy()})
    counter.widen("c")
    own = plain.bins(counter.counts["c"], counter.sums["c"])
    assert own.n == len(values) and own.rough.any()
    fine = plain.finer(own)
    assert fine.n > plain.n
    for grid in (plain, fine):
        at = grid.of(values).copy()
        low, high = grid.ends()
        assert (np.diff(at) >= 0).all() and (low[at] <= values).all() and (values <= high[at]).all()
        assert (low[1:] == high[:-1] + 1).all()


def test_counts_wider_than_their_first_type(monkeypatch):
    monkeypatch.setattr(PO, "MOST_COUNT", 100)
    counter = PO.GridCounter({"c": PO.Grid()})
    for k in range(7):
        counter.add({"c": np.full(60, 5.0)})
    assert sum(int(PO.unpacked(r["cells"]).sum()) for r in counter.rows() if r["chunk"] < -1) == 420
    assert PO.unpacked(PO.packed(np.arange(PO.CHUNK) * 3)).sum() == 3 * PO.CHUNK * (PO.CHUNK - 1) // 2


def test_tiles_are_the_whole_product(monkeypatch):
    monkeypatch.setattr(PO, "TILE", 50)
    rng = np.random.default_rng(4)
    a, b = {"c": rng.normal(size=(23, 3)) / 9}, {"c": rng.normal(size=(17, 3)) / 9}
    got = np.concatenate([t["c"].copy() for t in PO.meeting(a, b)])
    assert got == pytest.approx(np.rint(a["c"] @ b["c"].T * PO.UNIT).ravel(), abs=1)
    got = np.sort(np.concatenate([t["c"].copy() for t in PO.meeting(a, a)]))
    assert got == pytest.approx(np.sort(np.rint((a["c"] @ a["c"].T)[np.triu_indices(23, 1)] * PO.UNIT)), abs=1)
