"""Read-outs from one scan against least squares on collected rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnlens.operators import probes as PB


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 6)) + 3
    y = x @ [1, -2, 0, 0.5, 0, 3] + rng.standard_normal(400) * 0.3
    out = []
    for i in range(400):
        vec = None if i == 7 else [float("nan")] * 6 if i == 8 else [None] * 6 if i == 9 else x[i].tolist()
        out.append((i, vec, float(y[i]), None if i % 4 == 1 else float(y[i] ** 2), 5.0))
    return out


def frame(spark, rows, parts):
    return spark.createDataFrame(rows, "i long, v array<double>, y double, sq double, same double").repartition(parts)


def plain(rows, col, penalty):
    def part(held):
        own = [r for r in rows if r[0] not in (7, 8, 9) and (r[0] % 5 == 0) == held and r[col] is not None]
        return np.array([[1, *r[1]] for r in own]), np.array([r[col] for r in own])
    (z, y), (zt, yt) = part(False), part(True)
    eye = np.eye(z.shape[1]) * penalty
    eye[0, 0] = 0
    beta = np.linalg.solve(z.T @ z + eye, z.T @ y)
    r2 = lambda z, y: 1 - ((y - z @ beta) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    return len(y), len(yt), r2(z, y), r2(zt, yt), np.corrcoef(zt @ beta, yt)[0, 1]


def test_ridge_is_least_squares(spark, rows):
    df = frame(spark, rows, 5)
    got = {(r.feature, r.penalty): r for r in PB.ridge_probes(df, "v", ["y", "sq", "same"], F.col("i") % 5 == 0, [0.0, 10.0]).collect()}
    for col, name in ((2, "y"), (3, "sq")):
        for p in (0.0, 10.0):
            r = got[name, p]
            assert np.allclose([r.n_train, r.n_test, r.r2_train, r.r2_test, r.corr_test], plain(rows, col, p), rtol=1e-6)
    assert got["same", 0.0].r2_train is None and got["same", 0.0].n_train > 0


def test_partitions_do_not_matter(spark, rows):
    one, many = (PB.component_probes(frame(spark, rows, n), "v", ["y", "sq"], F.col("i") % 5 == 0).orderBy("feature", "component").toPandas() for n in (1, 9))
    assert np.allclose(one.drop(columns="feature"), many.drop(columns="feature"), rtol=1e-8)


def test_wide_vectors_travel_in_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((700, 300))
    y = x @ rng.standard_normal(300)
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(700)], "i long, v array<double>, y double")
    r = PB.ridge_probes(df, "v", ["y"], F.col("i") % 7 == 0).first()
    assert r.r2_train == pytest.approx(1, abs=1e-6) and r.r2_test == pytest.approx(1, abs=1e-6)


def test_flat_components_empty_tables(spark, rows):
    df = frame(spark, [(r[0], None if r[1] is None else [1.0], r[2], r[3], r[4]) for r in rows], 3)
    r = PB.component_probes(df, "v", ["y"], F.col("i") % 5 == 0).first()
    assert (r.slope, r.r2_train) == (None, None) and r.n_train > 0
    assert PB.component_probes(df.where("i < 0"), "v", ["y"], F.col("i") % 5 == 0).count() == 0
    assert PB.ridge_probes(df.where("i < 0"), "v", ["y"], F.col("i") % 5 == 0).first().n_train == 0
