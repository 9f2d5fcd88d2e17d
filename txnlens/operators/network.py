"""Training the scoring network: synchronous data-parallel gradient steps.

Rows are written once, partitioned by split and by batch; a row's batch is a hash of
its key. A step reads its batch only: every task adds up the gradient of its rows in
numpy, task sums are added in a tree of two levels, and one vector of the network's
size reaches the driver, which takes an Adam step and sends the weights out again.
Nothing a row long is ever collected, and as sums do not depend on how rows are dealt,
neither does the result (up to the order of additions).

The loss is binary cross-entropy with positives weighted n_neg / max(1, n_pos). After
each epoch the validation AUC (exact, see ``metrics.auc_roc``) decides: the weights of
the best epoch are kept, the step size halves after ``PLATEAU`` epochs without a new
best, and training stops after ``patience`` such epochs. Inputs are embeddings of
categorical ids and scaled numerics, layers are linear with exact GELU between them.
There is no dropout.

Null labels take no part; null numerics count as 0 (the mean, as they are scaled), ids
outside a table's rows as its last. Without positives or negatives in the validation
split there is no AUC, and the last epoch's weights are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.operators import metrics as M
from txnlens.operators.balance import positive_weight
from txnlens.operators.models import embedding_dim, gelu, gelu_both
from txnlens.session import shared_path

#: Widths of the hidden layers, step size, weight decay, epochs, patience.
HIDDEN, STEP, DECAY, EPOCHS, PATIENCE = (256, 128, 128), 1e-3, 1e-4, 20, 3
#: The bound of a gradient's norm; epochs until the step halves, its least; what counts as better.
CLIP, PLATEAU, LEAST_STEP, BETTER = 1.0, 2, 1e-5, 1e-4


@dataclass
class Network:
    """Embedding tables by column and layers (weights, biases); ``flat`` and ``like``
    turn all of them to one vector and back."""

    embeddings: dict[str, np.ndarray]
    layers: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def begun(cls, sizes: dict[str, int], n_num: int, hidden: tuple[int, ...], seed: int) -> Network:
        """Normal embeddings and uniform layers of half width 1 / sqrt(inputs)."""
        rng = np.random.default_rng(seed)
        embeddings = {c: rng.normal(size=(n, embedding_dim(n))) for c, n in sizes.items()}
        widths = [sum(e.shape[1] for e in embeddings.values()) + n_num, *hidden, 1]
        layers = []
        for d_in, d_out in zip(widths, widths[1:]):
            half = 1 / math.sqrt(max(d_in, 1))
            layers.append((rng.uniform(-half, half, (d_out, d_in)), rng.uniform(-half, half, d_out)))
        return cls(embeddings, layers)

    def _arrays(self) -> list[np.ndarray]:
        return [*self.embeddings.values(), *(x for layer in self.layers for x in layer)]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self._arrays()])

    def like(self, flat: np.ndarray) -> Network:
        parts, at = [], 0
        for x in self._arrays():
            parts.append(flat[at: at + x.size].reshape(x.shape))
            at += x.size
        e = len(self.embeddings)
        return Network(dict(zip(self.embeddings, parts)), list(zip(parts[e::2], parts[e + 1::2])))

    def inputs(self, ids: dict[str, np.ndarray], nums: np.ndarray) -> np.ndarray:
        return np.concatenate([*(self.embeddings[c][ids[c]] for c in self.embeddings), nums], axis=1)

    def logits(self, x: np.ndarray, first: int = 0) -> np.ndarray:
        """From layer ``first`` on; with 0, from the inputs."""
        for k, (w, b) in enumerate(self.layers[first:], first):
            x = x @ w.T + b
            if k < len(self.layers) - 1:
                x = gelu(x)
        return x[:, 0]

    def gradient(self, ids: dict[str, np.ndarray], nums: np.ndarray, label: np.ndarray, positive: float) -> tuple[float, np.ndarray]:
        """Loss and gradient, both summed over the rows."""
        before, slopes, h = [], [], self.inputs(ids, nums)
        for k, (w, b) in enumerate(self.layers):
            before.append(h)
            h = h @ w.T + b
            if k < len(self.layers) - 1:
                h, slope = gelu_both(h)
                slopes.append(slope)
        z = h[:, 0]
        weight = np.where(label > 0, positive, 1.0)
        loss = float((weight * np.logaddexp(0.0, np.where(label > 0, -z, z))).sum())
        d = (weight * (0.5 * (1 + np.tanh(z / 2)) - label))[:, None]
        layers: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(len(self.layers) - 1, -1, -1):
            if k < len(self.layers) - 1:
                d = d * slopes[k]
            layers.append((d.T @ before[k], d.sum(axis=0)))
            d = d @ self.layers[k][0]
        tables, at = {}, 0
        for c, e in self.embeddings.items():
            tables[c] = np.stack([np.bincount(ids[c], d[:, at + j], len(e)) for j in range(e.shape[1])], axis=1)
            at += e.shape[1]
        return loss, Network(tables, layers[::-1]).flat()


@dataclass
class Adam:
    step: float
    decay: float
    m: np.ndarray | float = 0.0
    v: np.ndarray | float = 0.0
    t: int = 0

    def moved(self, at: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        norm = float(np.linalg.norm(gradient))
        g = gradient * min(1.0, CLIP / (norm + 1e-6)) + self.decay * at
        self.t += 1
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.999 * self.v + 0.001 * g * g
        return at - self.step * (self.m / (1 - 0.9 ** self.t)) / (np.sqrt(self.v / (1 - 0.999 ** self.t)) + 1e-8)


@dataclass
class Fit:
    """A trained network, its best epoch and what every epoch gave."""

    network: Network
    best_epoch: int
    history: list[dict] = field(default_factory=list)


def _columns(pdf, network: Network, nums: list[str]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    ids = {c: np.clip(pdf[c].fillna(len(e) - 1).to_numpy(np.int64), 0, len(e) - 1) for c, e in network.embeddings.items()}
    return ids, np.nan_to_num(pdf[nums].to_numpy(np.float64)) if nums else np.zeros((len(pdf), 0))


def summed_gradient(rows: DataFrame, network: Network, nums: list[str], positive: float) -> tuple[int, float, np.ndarray]:
    """(rows, loss, gradient), summed over ``rows`` (the network's id columns, ``nums``
    and ``y``)."""
    context, cats = rows.sparkSession.sparkContext, list(network.embeddings)
    shared = context.broadcast(network)

    def own(batches) -> Iterator:
        import pandas as pd
        n, total, net = 0, None, shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            loss, g = net.gradient(*_columns(pdf, net, nums), pdf["y"].to_numpy(np.float64), positive)
            total = np.append(g, loss) if total is None else total + np.append(g, loss)
            n += len(pdf)
        if n:
            yield pd.DataFrame({"n": [n], "total": [total.tobytes()]})

    def add(batches) -> Iterator:
        import pandas as pd
        n, total = 0, None
        for pdf in batches:
            for k, t in zip(pdf["n"], pdf["total"]):
                t = np.frombuffer(t)
                n, total = n + int(k), t if total is None else total + t
        if n:
            yield pd.DataFrame({"n": [n], "total": [total.tobytes()]})

    parts = rows.select(*cats, *nums, "y").mapInPandas(own, "n long, total binary")
    width = max(int(math.sqrt(rows.rdd.getNumPartitions())), 1)  # of n tasks sqrt(n) sums meet on the driver
    got = parts.repartition(width).mapInPandas(add, "n long, total binary").collect()
    shared.unpersist()
    totals = [np.frombuffer(r["total"]) for r in sorted(got, key=lambda r: (r["n"], r["total"]))]
    if not totals:
        return 0, 0.0, np.zeros_like(network.flat())
    total = np.sum(totals, axis=0)
    return sum(r["n"] for r in got), float(total[-1]), total[:-1]


def scored(df: DataFrame, network: Network, nums: list[str], keep: list[str]) -> DataFrame:
    """``keep`` columns and ``score``, the network's probability."""
    shared = df.sparkSession.sparkContext.broadcast(network)
    cats = list(network.embeddings)

    def run(batches):
        net = shared.value
        for pdf in batches:
            z = net.logits(net.inputs(*_columns(pdf, net, nums)))
            yield pdf[keep].assign(score=0.5 * (1 + np.tanh(z / 2)))

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*dict.fromkeys([*keep, *cats, *nums])).mapInPandas(run, f"{kinds}, score double")


def train_network(df: DataFrame, key: str, sizes: dict[str, int], nums: list[str], label: str, split: str = "train_split",
                  hidden: tuple[int, ...] = HIDDEN, epochs: int = EPOCHS, batches: int = 1, step: float = STEP, decay: float = DECAY,
                  patience: int = PATIENCE, seed: int = 0) -> Fit:
    """Fit on the rows of split ``train``, stop by the rows of split ``val``. ``sizes``:
    the id columns and how many ids each has. ``batches``: steps an epoch."""
    spark = df.sparkSession
    path = shared_path(spark, "network-rows")
    rows = df.where(F.col(label).isNotNull() & F.col(split).isin("train", "val")).select(
        *sizes, *nums, F.col(label).cast("double").alias("y"), F.col(split).alias("part"),
        F.when(F.col(split) == "train", F.pmod(F.xxhash64(key), F.lit(batches))).otherwise(0).cast("int").alias("batch"))
    rows.write.partitionBy("part", "batch").parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    train, val = rows.where("part = 'train'"), rows.where("part = 'val'")
    positive = float(positive_weight(train, "y").first()["pos_weight"] or 1.0)  # no rows: any weight
    network = Network.begun(sizes, len(nums), hidden, seed)
    adam = Adam(step, decay)
    fit, best, since, waited = Fit(network, 0), -1.0, 0, 0
    for epoch in range(1, epochs + 1):
        seen, total = 0, 0.0
        for k in range(batches):
            n, loss, gradient = summed_gradient(train.where(F.col("batch") == k), network, nums, positive)
            if n:
                network = network.like(adam.moved(network.flat(), gradient / n))
                seen, total = seen + n, total + loss
        auc = M.auc_roc(scored(val, network, nums, ["y"]), "score", "y").first()["auc_roc"]
        fit.history.append({"epoch": epoch, "loss": total / seen if seen else None, "val_auc": auc, "step": adam.step})
        if auc is None or auc > best + BETTER:
            best, since, waited = auc or best, 0, 0
            fit.network, fit.best_epoch = network, epoch
            continue
        since, waited = since + 1, waited + 1
        if waited > PLATEAU:
            adam.step, waited = max(adam.step / 2, LEAST_STEP), 0
        if since >= patience:
            break
    return fit
