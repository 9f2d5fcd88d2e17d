"""Evaluations the reference specifies in its plan (N1-N9), as aggregations
over prediction and claim tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.functions import vectors as V
from txnlens.operators.models import gelu
from txnlens.functions.scalar import score_bin
from txnlens.operators import metrics as M


def majority_baseline(train: DataFrame, label: str, score: str) -> DataFrame:
    """N1: the majority label (ties -> smaller label) and the mean score of
    the training rows, as a one-row table."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("c"))
    maj = counts.agg(F.max_by(F.col(label), F.struct(F.col("c"), -F.col(label))).alias("majority_label"))
    mean = train.agg(F.avg(score).alias("mean_score"))
    return M.merge_rows(maj, mean)


def accuracy_by_system(pred: DataFrame, truth: DataFrame, key: str,
                       tasks: dict[str, tuple[str, str]]) -> DataFrame:
    """N2: ``(system, task, n, accuracy)``; ``tasks`` maps a task to
    (predicted column, true column)."""
    j = pred.join(truth, key)
    parts = [j.groupBy("system").agg(F.lit(t).alias("task"), F.count(F.lit(1)).alias("n"),
                                     F.avg((F.col(p) == F.col(tr)).cast("double")).alias("accuracy"))
             for t, (p, tr) in tasks.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def comparison_table(long: DataFrame, metrics: list[str]) -> DataFrame:
    """N9: one row per system, one column per metric (pivot over a known list)."""
    return long.groupBy("system").pivot("task", metrics).agg(F.first("accuracy"))


def model_error_slice(df: DataFrame, score: str, label: str, n_bins: int = 5) -> DataFrame:
    """N3: rows whose score bucket disagrees with the label (high score and
    legit, low score and fraud), counted per (label, bucket) cell."""
    b = score_bin(score, n_bins)
    err = ((b >= n_bins - 2) & (F.col(label) == 0)) | ((b <= 1) & (F.col(label) == 1))
    return (df.where(err).groupBy(F.col(label).alias("label"), b.alias("score_bin"))
            .agg(F.count(F.lit(1)).alias("n")))


# Claim kinds read back from rendered text: pattern and the true column.
CLAIM_PATTERNS = {
    "amount": (r"Amount: \$([0-9.]+)", "amt"),
    "hour": (r"Time: ([0-9]{2}):xx", "hour_of_day"),
    "velocity_1h": (r"Card velocity: ([0-9]+) txn in past 1h", "velocity_1h"),
    "velocity_24h": (r"Card velocity: ([0-9]+) txn in past 24h", "velocity_24h"),
    "zscore": (r"z=([+-][0-9.]+) ", "amt_zscore"),
    "tenure": (r"Card tenure: ([0-9]+) day", "card_tenure_days"),
}
# Half a unit of the last place that is printed.
CLAIM_TOLERANCE = {"amount": 0.005, "zscore": 0.05, "tenure": 0.5}


def claims_from_text(df: DataFrame, text: str, key: str) -> DataFrame:
    """Atomic claims ``(key, kind, claimed double)`` parsed from text."""
    arr = F.array(*[F.struct(F.lit(k).alias("kind"),
                             F.regexp_extract(F.col(text), p, 1).alias("v"))
                    for k, (p, _) in CLAIM_PATTERNS.items()])
    return (df.select(key, F.explode(arr).alias("c")).where(F.col("c.v") != "")
            .select(key, F.col("c.kind").alias("kind"), F.col("c.v").cast("double").alias("claimed")))


def claim_precision(claims: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """N4: per claim kind, the share of claims that match the true feature."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("double").alias("true"))
                      for k, (_, c) in CLAIM_PATTERNS.items()])
    t = truth.select(key, F.explode(kinds).alias("t")).select(key, "t.kind", "t.true")
    j = claims.join(t, [key, "kind"])
    tol = F.coalesce(F.create_map(*[F.lit(x) for kv in CLAIM_TOLERANCE.items() for x in kv])
                     [F.col("kind")], F.lit(0.0))
    ok = F.abs(F.col("claimed") - F.col("true")) <= tol + F.lit(1e-9)
    return j.groupBy("kind").agg(F.count(F.lit(1)).alias("n_claims"),
                                 F.avg(ok.cast("double")).alias("precision"))


def steering_sweep(df: DataFrame, vec: str, directions: dict[str, list[float]],
                   alphas: list[float], score_dir: list[float]) -> DataFrame:
    """N7: ``h + alpha |h| D / |D|`` for each direction and alpha (expanded
    with ``explode``, not a cross join), rescored by the cosine with
    ``score_dir``; mean score per (direction, alpha)."""
    sd = np.asarray(score_dir, dtype=float)
    sd = sd / (np.linalg.norm(sd) + 1e-12)
    sd_col = F.array(*[F.lit(float(x)) for x in sd])
    grid = F.array(*[F.struct(F.lit(name).alias("direction"), F.lit(float(a)).alias("alpha"),
                              F.array(*[F.lit(float(x)) for x in
                                        np.asarray(d) / (np.linalg.norm(d) + 1e-12)]).alias("u"))
                     for name, d in directions.items() for a in alphas])
    x = df.select(V.as_double(vec).alias("h"), F.explode(grid).alias("g"))
    steered = V.let(V.vec_norm("h"), lambda n: F.zip_with(
        "h", F.col("g.u"), lambda h, u: h + F.col("g.alpha") * n * u))
    s = x.select(F.col("g.direction").alias("direction"), F.col("g.alpha").alias("alpha"),
                 V.cosine(steered, sd_col).alias("score"))
    return s.groupBy("direction", "alpha").agg(F.avg("score").alias("mean_score"),
                                               F.count(F.lit(1)).alias("n"))


def tail_scores(h: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The network's score from a captured hidden layer on: the layers behind it, GELU
    between them, sigmoid of the logit."""
    for k, (w, b) in enumerate(layers):
        h = h @ w.T + b
        if k < len(layers) - 1:
            h = gelu(h)
    return 0.5 * (1 + np.tanh(h[:, 0] / 2))


def network_steering(df: DataFrame, vec: str, directions: dict[str, list[float]], alphas: list[float],
                     layers: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """N7 through the network: ``h + alpha |h| D / |D|`` enters it again behind the
    captured layer ``vec``. Per (direction, alpha): n, mean score, mean shift against
    the score of ``h`` itself, and the share of rows whose score fell. Every Arrow
    batch is moved along all directions as matrices; a task hands on one row a
    (direction, alpha). Rows without a vector take no part."""
    unit = {k: np.asarray(d, float) / (np.linalg.norm(d) + 1e-12) for k, d in directions.items()}
    shared = df.sparkSession.sparkContext.broadcast((unit, layers))
    width = len(next(iter(unit.values()))) if unit else 0

    def run(batches):
        import pandas as pd
        unit, layers = shared.value
        sums = {(k, a): np.zeros(4) for k in unit for a in alphas}
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                h = np.stack(pdf["h"].iloc[at: at + 4096].to_numpy())
                own, norm = tail_scores(h, layers), np.linalg.norm(h, axis=1, keepdims=True)
                for k, a in sums:
                    s = tail_scores(h + a * norm * unit[k], layers)
                    sums[k, a] += (len(h), s.sum(), (s - own).sum(), (s < own).sum())
        yield pd.DataFrame([(k, float(a), *t) for (k, a), t in sums.items()], columns=["direction", "alpha", "n", "score", "shift", "fell"])

    rows = df.where(F.col(vec).isNotNull() & (F.size(vec) == width)).select(V.as_double(vec).alias("h"))
    sums = rows.mapInPandas(run, "direction string, alpha double, n double, score double, shift double, fell double")
    total = sums.groupBy("direction", "alpha").agg(*[F.sum(c).alias(c) for c in ("n", "score", "shift", "fell")]).where("n > 0")
    return total.select("direction", "alpha", F.col("n").cast("long").alias("n"), (F.col("score") / F.col("n")).alias("mean_score"),
                        (F.col("shift") / F.col("n")).alias("mean_shift"), (F.col("fell") / F.col("n")).alias("share_lower"))
