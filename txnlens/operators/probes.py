"""Linear read-outs of many targets from one scan (N5).

Rows are split into a fitting and a held-out part; per part the moments Z'Z, Z'y and
y'y of Z = [1, x] are summed with numpy inside tasks, as packed blocks of matrix rows
that are added where they meet. Every target, every ridge penalty and every single
component is then solved from the same moments, on the driver: (d + 1)^2 numbers a part,
and one more matrix a part for a target that has nulls.

Defined results: a row without a vector, or with a null or non-finite component, takes
no part; a null or non-finite target only leaves out that target; a fit without spread
in its target has no R2 (null).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlens.functions import vectors as V
from txnlens.operators.geometry import _BLOCK_SCHEMA, BLOCK_ROWS, _add_blocks

PARTS = ("fit", "held")


@dataclass
class Moments:
    """Sums over the rows of one part that have one target."""
    a: np.ndarray
    c: np.ndarray
    yy: float

    @property
    def n(self) -> int:
        return int(round(self.a[0, 0]))

    @property
    def spread(self) -> float:
        return self.yy - self.c[0] ** 2 / self.n if self.n else 0.0

    def solved(self, penalty: float) -> np.ndarray:
        """Intercept and coefficients; the intercept is not penalised. Without a unique
        answer, the shortest one."""
        ridge = np.eye(len(self.c)) * penalty
        ridge[0, 0] = 0
        return np.linalg.lstsq(self.a + ridge, self.c, rcond=None)[0]

    def r2(self, beta: np.ndarray) -> float | None:
        if self.spread <= 1e-12 * max(self.yy, 1e-300):
            return None
        return float(1 - (self.yy - 2 * beta @ self.c + beta @ self.a @ beta) / self.spread)

    def corr(self, beta: np.ndarray) -> float | None:
        if not self.n:
            return None
        mean = beta @ self.a[0] / self.n
        own = beta @ self.a @ beta - self.n * mean ** 2
        both = beta @ self.c - mean * self.c[0]
        return float(both / np.sqrt(own * self.spread)) if own > 1e-12 and self.spread > 1e-12 else None

    def only(self, component: int) -> Moments:
        keep = [0, component + 1]
        return Moments(self.a[np.ix_(keep, keep)], self.c[keep], self.yy)


def probe_moments(df: DataFrame, vec: str, targets: list[str], held: Column) -> dict[tuple[str, str], Moments]:
    """(part, target) -> moments, from one scan of the vector and the targets."""
    targets = list(targets)

    def blocks(name, z):
        for k in range(0, z.shape[1], BLOCK_ROWS):
            yield (name, k // BLOCK_ROWS), z[:, k:k + BLOCK_ROWS].T @ z

    def products(pdf):
        if len(pdf) == 0:
            return
        x = np.stack(pdf["_x"].to_numpy()).astype(np.float64)
        ys = pdf[targets].to_numpy(dtype=np.float64)
        whole = np.isfinite(x).all(1)
        z = np.concatenate([np.ones((len(x), 1)), x], axis=1)
        for part, of in zip(PARTS, (~pdf["_held"].to_numpy(bool), pdf["_held"].to_numpy(bool))):
            rows = whole & of
            yield from blocks(f"Z|{part}", z[rows])
            for j, t in enumerate(targets):
                has = rows & np.isfinite(ys[:, j])
                y = ys[has, j]
                yield (f"c|{part}|{t}", 0), np.append(z[has].T @ y, y @ y)
                without = rows & ~has
                if without.any():
                    yield from blocks(f"N|{part}|{t}", z[without])

    def unpacked(pdf):
        for name, block, cells in zip(pdf["name"], pdf["block"], pdf["cells"]):
            yield (name, int(block)), np.frombuffer(cells, np.float64)

    src = df.select(V.as_double(vec).alias("_x"), held.alias("_held"), *[F.col(t).cast("double").alias(t) for t in targets])
    src = src.where(F.col("_x").isNotNull() & (F.size("_x") > 0) & F.col("_held").isNotNull() & F.forall("_x", lambda v: v.isNotNull()))
    got = (src.mapInPandas(lambda it: _add_blocks(it, products), _BLOCK_SCHEMA).repartition("name", "block")
           .mapInPandas(lambda it: _add_blocks(it, unpacked), _BLOCK_SCHEMA).collect())
    found: dict[str, dict[int, np.ndarray]] = {}
    for r in got:
        found.setdefault(r["name"], {})[r["block"]] = np.frombuffer(r["cells"], np.float64)

    def matrix(name: str, size: int) -> np.ndarray:
        parts = found.get(name)
        return np.concatenate([parts[k] for k in sorted(parts)]).reshape(size, size) if parts else np.zeros((size, size))

    out = {}
    for part in PARTS:
        for t in targets:
            c = found.get(f"c|{part}|{t}", {0: np.zeros(2)})[0]
            size = len(c) - 1
            out[part, t] = Moments(matrix(f"Z|{part}", size) - matrix(f"N|{part}|{t}", size), c[:-1], float(c[-1]))
    return out


def ridge_probes(df: DataFrame, vec: str, targets: list[str], held: Column, penalties: list[float] = (0.0,)) -> DataFrame:
    """How much of each target a linear read-out of the whole vector recovers:
    ``(feature, penalty, n_train, n_test, r2_train, r2_test, corr_test)``."""
    m = probe_moments(df, vec, targets, held)
    rows = []
    for t in targets:
        fit, test = m["fit", t], m["held", t]
        for p in penalties:
            beta = fit.solved(p) if fit.n else np.zeros(len(fit.c))
            rows.append((t, float(p), fit.n, test.n, fit.r2(beta) if fit.n else None, test.r2(beta), test.corr(beta)))
    return df.sparkSession.createDataFrame(rows, "feature string, penalty double, n_train long, n_test long, r2_train double, r2_test double, corr_test double")


def component_probes(df: DataFrame, vec: str, targets: list[str], held: Column) -> DataFrame:
    """The same for every component alone: ``(feature, component, n_train, n_test, slope,
    intercept, r2_train, r2_test)``; no slope where the component has no spread."""
    m = probe_moments(df, vec, targets, held)
    rows = []
    for t in targets:
        fit, test = m["fit", t], m["held", t]
        for i in range(len(fit.c) - 1):
            own, other = fit.only(i), test.only(i)
            flat = not own.n or own.a[1, 1] - own.a[0, 1] ** 2 / own.n <= 1e-12 * max(own.a[1, 1], 1e-300)
            beta = None if flat else own.solved(0.0)
            rows.append((t, i, own.n, other.n, *((None,) * 4 if flat else (float(beta[1]), float(beta[0]), own.r2(beta), other.r2(beta)))))
    return df.sparkSession.createDataFrame(rows, "feature string, component int, n_train long, n_test long, slope double, intercept double, r2_train double, r2_test double")
