"""Pair products: what is sent on in a pass follows the cores, not the pairs."""

import numpy as np
import pytest

from txnlens.operators import pair_order as PO


def table(spark, n, d=5):
    rng = np.random.default_rng(8)
    a = rng.normal(size=(n, d))
    return a, spark.createDataFrame([(k, x) for k, x in enumerate(a.tolist())], "row_idx long, a array<double>").repartition(3)


@pytest.mark.parametrize("part_blocks", [256, 2])
def test_few_tasks_make_all_products(spark, monkeypatch, part_blocks):
    monkeypatch.setattr(PO, "BLOCK_ROWS", 10)
    monkeypatch.setattr(PO, "PART_BLOCKS", part_blocks)
    monkeypatch.setattr(PO, "AT_ONCE", 300)
    a, df = table(spark, 200)
    products = PO.pair_cosines(df, "row_idx", {"c": "a"})
    sent = products._each(lambda: PO.CellCounter({"c": np.linspace(-1, 1, 9)}), PO._ROWS).where("chunk >= 0").count()
    parts = max(4, 20 // part_blocks if part_blocks == 2 else 0)  # 4 cores: 4 parts; or of 2 blocks at most
    assert sent <= parts * (parts + 1) / 2
    u = a / np.linalg.norm(a, axis=1, keepdims=True)
    c = (u @ u.T)[np.triu_indices(200, 1)]
    bins = products.ordered([0.5], ranks=True)["c"]
    assert bins.n == len(c) and bins.quantile(0.5) == pytest.approx(np.median(c)) and bins.total == pytest.approx(c.sum())
