"""Geometry of vector sets without materialising pairs.

Statistics over all i<j pairs of unit vectors follow from d x d moment
matrices, so a report over n rows costs O(n d^2) in one distributed pass and
never builds the n^2 pairs:

* ``sum_{i<j} cos_ij   = (|sum u|^2 - sum |u|^2) / 2``
* ``sum_{i<j} cos_ij^2 = (|U'U|_F^2 - sum |u|^4) / 2``
* ``sum_{i<j} cos_ij cos'_ij = (|U'V|_F^2 - sum |u|^2 |v|^2) / 2``

giving exact mean, population std and Pearson r of pair cosines. Their order
statistics (median, p5, p95, Spearman) are in ``pair_order``.

Partial moments are computed per partition with numpy (``mapInPandas``, Arrow
batches, one BLAS product per batch) and travel as packed blocks of matrix rows,
which are added where they meet; a d x d matrix reaches the driver only where
its eigenvalues are taken.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.functions import vectors as V

_BLOCK_SCHEMA = "name string, block int, cells binary"
#: Matrix rows that travel as one packed cell.
BLOCK_ROWS = 256


def _add_blocks(it, blocks_of):
    """Running sums of packed blocks: a task holds one array per block, whatever
    the number of rows or partitions."""
    import pandas as pd
    acc: dict = {}
    for pdf in it:
        for key, arr in blocks_of(pdf):
            if key in acc:
                acc[key] += arr.reshape(-1)
            else:
                acc[key] = arr.reshape(-1).copy()
    if acc:
        yield pd.DataFrame({"name": [k[0] for k in acc], "block": [k[1] for k in acc],
                            "cells": [a.tobytes() for a in acc.values()]})


def moment_sums(df: DataFrame, cols: list[str], cross: list[tuple[str, str]] = (),
                matrices: bool = True) -> dict:
    """Sums over rows: ``n``, ``S[c]`` (d), ``sq[c]`` = sum |c|^2, ``q4[c]`` =
    sum |c|^4, ``ab[a,b]`` = sum |a|^2 |b|^2 and, of ``G[c]`` = sum c c' and
    ``C[a,b]`` = sum a b', the squared Frobenius norms ``G2[c]``, ``C2[a,b]``;
    with ``matrices`` the d x d matrices too.

    A task emits each matrix as packed blocks of rows, the blocks are added where
    they meet, and norms are taken there; only matrices that are asked for reach
    the driver."""
    cross = list(cross)

    def products(pdf):
        if len(pdf) == 0:
            return
        mats = {c: np.stack(pdf[c].to_numpy()).astype(np.float64) for c in cols}
        sq = {c: np.einsum("ij,ij->i", m, m) for c, m in mats.items()}
        yield ("n", 0), np.array([float(len(pdf))])
        for c, m in mats.items():
            yield (f"S|{c}", 0), m.sum(axis=0)
            yield (f"sq|{c}", 0), np.array([sq[c].sum()])
            yield (f"q4|{c}", 0), np.array([(sq[c] * sq[c]).sum()])
        for a, b in cross:
            yield (f"ab|{a}|{b}", 0), np.array([(sq[a] * sq[b]).sum()])
        for name, left, right in [(f"G|{c}", c, c) for c in cols] + [(f"C|{a}|{b}", a, b) for a, b in cross]:
            for k in range(0, mats[left].shape[1], BLOCK_ROWS):
                yield (name, k // BLOCK_ROWS), mats[left][:, k:k + BLOCK_ROWS].T @ mats[right]

    def unpacked(pdf):
        for name, block, cells in zip(pdf["name"], pdf["block"], pdf["cells"]):
            x = np.frombuffer(cells, np.float64)
            yield (name, int(block)), x

    def partial(it):
        yield from _add_blocks(it, products)

    def total(it):
        for pdf in _add_blocks(it, unpacked):
            for name, out in (("G|", "G2|"), ("C|", "C2|")):
                own = pdf[pdf["name"].str.startswith(name)]
                if len(own):
                    square = [(np.frombuffer(c, np.float64) ** 2).sum() for c in own["cells"]]
                    yield own.assign(name=out + own["name"].str[2:], cells=[np.array([x]).tobytes() for x in square])
            yield pdf if matrices else pdf[~pdf["name"].str.match("[GC][|]")]

    src = df.select(*[V.as_double(c).alias(c) for c in cols])
    got = (src.mapInPandas(partial, _BLOCK_SCHEMA).repartition("name", "block")
           .mapInPandas(total, _BLOCK_SCHEMA).collect())
    parts: dict = {}
    for r in got:
        parts.setdefault(r["name"], {})[r["block"]] = np.frombuffer(r["cells"], np.float64)
    res: dict = {"n": int(round(float(parts.pop("n", {0: [0.0]})[0][0])))}
    width = {c: len(parts[f"S|{c}"][0]) for c in cols if f"S|{c}" in parts}
    for name, blocks in parts.items():
        kind, *key = name.split("|")
        if kind == "S":
            val = blocks[0]
        elif kind in ("G", "C"):
            val = np.concatenate([blocks[k] for k in sorted(blocks)]).reshape(-1, width[key[-1]])
        else:
            val = float(sum(b[0] for b in blocks.values()))
        res.setdefault(kind, {})[tuple(key) if len(key) > 1 else key[0]] = val
    return res


def pair_cosine_stats(m: dict, u: str) -> dict:
    n = m["n"]
    n_pairs = n * (n - 1) // 2
    s = m["S"][u]
    s1 = (float(s @ s) - m["sq"][u]) / 2.0
    s2 = (m["G2"][u] - m["q4"][u]) / 2.0
    mean = s1 / n_pairs if n_pairs else None
    var = s2 / n_pairs - mean * mean if n_pairs else None
    return {"n_pairs": n_pairs, "mean": mean,
            "std": math.sqrt(max(var, 0.0)) if var is not None else None,
            "sum": s1, "sumsq": s2}


def pair_cosine_pearson(m: dict, u: str, v: str) -> float | None:
    a, b = pair_cosine_stats(m, u), pair_cosine_stats(m, v)
    n_pairs = a["n_pairs"]
    if not n_pairs or not a["std"] or not b["std"]:
        return None
    sab = (m["C2"][(u, v)] - m["ab"][(u, v)]) / 2.0
    cov = sab / n_pairs - a["mean"] * b["mean"]
    return cov / (a["std"] * b["std"])


def unit_columns(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """``out -> in``: geometry-normalised copies ``x / (|x| + 1e-12)``."""
    return df.select(*[V.unit_geometry(src).alias(out) for out, src in cols.items()])


def pairwise_report(df: DataFrame, vin: str, vout: str) -> dict:
    """Pair-cosine mean / std of both sets and their Pearson correlation."""
    u = unit_columns(df, {"u": vin, "w": vout})
    m = moment_sums(u, ["u", "w"], cross=[("u", "w")], matrices=False)
    a, b = pair_cosine_stats(m, "u"), pair_cosine_stats(m, "w")
    return {"n_pairs": a["n_pairs"], "in_mean": a["mean"], "in_std": a["std"],
            "out_mean": b["mean"], "out_std": b["std"],
            "pearson_r": pair_cosine_pearson(m, "u", "w")}


def energy_count(shares: np.ndarray, part: float) -> int | None:
    """How many leading shares it takes to reach ``part``; None if all do not."""
    reached = np.flatnonzero(np.add.accumulate(shares) >= part)
    return None if reached.size == 0 else int(reached[0]) + 1


def spectrum_report(eig: np.ndarray, shape: tuple[int, int]) -> dict:
    """Uncentered singular spectrum from the eigenvalues of X'X: components
    for 90 / 99 % of energy, entropy effective rank, top-20 and last-5
    singular values."""
    rank = min(shape)
    energy = np.maximum(eig, 0.0)
    energy = energy[np.argsort(-energy, kind="stable")][:rank]
    shares = energy / energy.sum()
    live = shares[shares > 0]
    entropy = float(-(live * np.log(live)).sum())
    singular = np.sqrt(energy).tolist()
    report = {f"n_components_{pct}": energy_count(shares, pct / 100) or rank for pct in (90, 99)}
    report.update(effective_rank=math.exp(entropy), singular_values_top20=singular[:20], singular_values_tail5=singular[-5:],
                  rows=int(shape[0]), dims=int(shape[1]), nominal_max_rank=int(rank))
    return report


def effective_rank(df: DataFrame, vec: str) -> dict:
    m = moment_sums(df, [vec])
    g = m["G"][vec]
    return spectrum_report(np.linalg.eigvalsh(g), (m["n"], g.shape[0]))


def pca_spectrum(df: DataFrame, vec: str, k: int = 50, normalize: bool = True) -> dict:
    """Explained-variance ratios of the centred covariance (MLlib PCA on the
    vectors; ratios are of the TOTAL variance) and the first number of
    components reaching 90 / 95 / 99 %."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    src = V.unit_stored(vec) if normalize else V.as_double(vec)
    x = df.select(array_to_vector(src).alias("features"))
    n = x.count()
    d = len(x.first()["features"])
    kk = max(1, min(k, n - 1, d))
    model = PCA(k=kk, inputCol="features", outputCol="pc").fit(x)
    ratios = model.explainedVariance.toArray()
    need = {pct: energy_count(ratios, pct / 100) or kk for pct in (90, 95, 99)}
    report = {f"components_{pct}pct": k for pct, k in need.items()}
    return {**report, "n_components": kk, "low_rank_note": need[99] <= 5, "n_dims": d, "n_samples": n,
            "explained_variance_ratio": ratios.tolist()}


def pca_components(df: DataFrame, vec: str, k: int) -> np.ndarray:
    """Top-k principal directions (k x d), fitted with MLlib PCA."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    x = df.select(array_to_vector(V.as_double(vec)).alias("features"))
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(x)
    return model.pc.toArray().T


# Up to this many coefficients W is inlined as literals; above, rows go
# through a numpy matmul with W broadcast once per executor.
INLINE_MAX_COEFS = 16_384


def project(df: DataFrame, vec: str, w: np.ndarray, b: np.ndarray | None, scale: float,
            out: str = "projected") -> DataFrame:
    """``normalize_to(W v + b, scale)``: an affine map with its output held at
    a fixed L2 norm. A small W is inlined as literal coefficients (each output
    element is a JVM dot product); a large one is broadcast and applied per
    Arrow batch with numpy."""
    b = np.zeros(w.shape[0]) if b is None else b
    if w.size > INLINE_MAX_COEFS:
        return _project_batched(df, vec, w, b, scale, out)
    v = V.as_double(vec)
    rows = []
    for r in range(w.shape[0]):
        coef = F.array(*[F.lit(float(x)) for x in w[r]])
        rows.append(V.vec_dot(v, coef) + F.lit(float(b[r])))
    raw = F.array(*rows)
    return df.withColumn(out, V.normalize_to(raw, F.lit(float(scale))))


def norm_check(df: DataFrame, vec: str) -> DataFrame:
    n = V.vec_norm(vec)
    return df.agg(F.avg(n).alias("norm_mean"), F.stddev_pop(n).alias("norm_std"),
                  F.count(F.lit(1)).alias("n"))


def pc_correlations(df: DataFrame, vec: str, k: int, targets: list[str]) -> DataFrame:
    """Per principal component: Pearson correlation of its projection with
    each target column (MLlib PCA projection, then one aggregate)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    x = df.withColumn("features", array_to_vector(V.as_double(vec)))
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(x)
    p = model.transform(x).withColumn("pc", vector_to_array("pc"))
    aggs = [F.corr(F.col("pc")[i], F.col(t).cast("double")).alias(f"{i}|{t}")
            for i in range(k) for t in targets]
    row = p.agg(*aggs).first()
    spark = df.sparkSession
    return spark.createDataFrame(
        [(i, t, row[f"{i}|{t}"]) for i in range(k) for t in targets],
        "component int, target string, corr double")


def _project_batched(df: DataFrame, vec: str, w: np.ndarray, b: np.ndarray, scale: float,
                     out: str) -> DataFrame:
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
    bc = df.sparkSession.sparkContext.broadcast((w.astype(np.float64), b.astype(np.float64)))
    schema = StructType(df.schema.fields + [StructField(out, ArrayType(DoubleType()))])

    def run(it):
        ww, bb = bc.value
        for pdf in it:
            if len(pdf) == 0:
                continue
            x = np.stack(pdf[vec].to_numpy()).astype(np.float64)
            y = x @ ww.T + bb
            y = y / (np.linalg.norm(y, axis=1, keepdims=True) + 1e-8) * scale
            pdf[out] = list(y)
            yield pdf

    return df.mapInPandas(run, schema)
