"""Toxicity with a bidirectional gated recurrent network, trained here in numpy.

A word's input joins its own (hashed) vector and the mean of its hashed character
trigram vectors. Windows of WINDOW words, half overlapping, run through a GRU in
both directions; attention over the positions pools the states to one logit. All
windows of a text are scored; a text's score is a logistic function of its
highest and its mean window logit.

The fit uses a bounded sample of labelled rows: at most SAMPLE_DOCS documents
with the least hashes of their ids, and at most SAMPLE_CHARS characters of them
(whole texts; one that does not fit is passed over, and if all of a label's are,
that is an error). Inputs are the texts' words and characters alone. The parameters
(about 1 MB) go to the tasks as a broadcast.

Defined results: null and empty texts, and texts without letters or digits, have
no windows and get the labelled share of toxic documents; if the labels are all
alike, every text gets their share; without labelled rows every score is 0.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, few_by_hash, held, mix64, named, with_text

SAMPLE_DOCS, SAMPLE_CHARS = 4000, 16_000_000
WINDOW, STRIDE = 32, 16
WORD_ROWS, GRAM_ROWS, DIM, HIDDEN, ATTEND = 1 << 14, 1 << 12, 8, 8, 8
EPOCHS, BATCH, RATE, DECAY, SEED = 5, 512, 0.01, 0.05, 17
HELD_OUT = 5
PROJECTED_WORDS = 250_000

#: Bytes of a word at most; text without blanks (Chinese, Thai) is one run.
PIECE = 64

#: Letters and digits (A-Z lowered) and bytes beyond ASCII.
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def model_words(text: str | None) -> list[bytes]:
    """Runs of word bytes; a run of more than PIECE bytes is several words, each of
    which begins with the last two bytes of the one before: no trigram is lost."""
    words = text.encode().translate(_WORD).split() if text else []
    if max(map(len, words), default=0) <= PIECE:
        return words
    return [w[at: at + PIECE] for w in words for at in range(0, max(1, len(w) - 2), PIECE - 2)]


def word_rows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's row; the trigram rows of all words (between marks), and whose
    they are, in order."""
    own = np.array([xxhash.xxh3_64_intdigest(w) % WORD_ROWS for w in words], np.int64)
    text = np.frombuffer(b"".join([b"<" + w + b">" for w in words]), np.uint8).astype(np.uint64)
    size = np.array([len(w) for w in words], np.int64)  # as many trigrams as bytes
    owner = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(owner)) + 2 * owner
    with np.errstate(over="ignore"):
        grams = mix64(text[at] << np.uint64(16) | text[at + 1] << np.uint64(8) | text[at + 2], 3) % np.uint64(GRAM_ROWS)
    return own, grams.astype(np.int64), owner


def windows(lengths: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """(owner, first word) of all windows of texts with so many words."""
    counts = np.where(lengths > 0, np.maximum(0, -(-(lengths - WINDOW) // stride)) + 1, 0)
    owner = np.repeat(np.arange(len(lengths)), counts)
    first = (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)) * stride
    return owner, first


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters ``p`` and passes; arrays are float32, time first."""

    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        normal = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        self.p = {
            "word": normal(WORD_ROWS, DIM, scale=0.01), "gram": normal(GRAM_ROWS, DIM, scale=0.01),
            "wx": normal(2 * DIM, 6 * HIDDEN, scale=0.3), "bx": np.zeros(6 * HIDDEN, np.float32),
            "u": normal(2, HIDDEN, 3 * HIDDEN, scale=0.3),
            "a": normal(2 * HIDDEN, ATTEND, scale=0.3), "v": normal(ATTEND, scale=0.3),
            "w": normal(2 * HIDDEN, scale=0.3), "b": np.zeros(1, np.float32),
        }

    def inputs(self, rows) -> np.ndarray:
        own, grams, owner = rows
        first = np.searchsorted(owner, np.arange(len(own)))  # words are not empty
        mean = np.add.reduceat(self.p["gram"][grams], first) / np.bincount(owner, minlength=len(own))[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][own], mean], 1)

    def project(self, rows) -> tuple[np.ndarray, np.ndarray]:
        """Gate inputs of distinct words, a table for each direction."""
        both = self.inputs(rows) @ self.p["wx"] + self.p["bx"]
        return np.ascontiguousarray(both[:, : 3 * HIDDEN]), np.ascontiguousarray(both[:, 3 * HIDDEN:])

    def forward(self, gates: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows; ``ids`` and ``mask`` are (WINDOW, windows). ``keep``:
        also what the backward pass needs."""
        steps, n = ids.shape
        u, h = self.p["u"], np.zeros((2, n, HIDDEN), np.float32)
        states = np.empty((steps, n, 2 * HIDDEN), np.float32)
        x = np.empty((2, n, 3 * HIDDEN), gates[0].dtype)
        full, kept = mask.all(1), []
        for t in range(steps):
            back = steps - 1 - t
            np.take(gates[0], ids[t], axis=0, out=x[0], mode="clip")
            np.take(gates[1], ids[back], axis=0, out=x[1], mode="clip")
            hu = h @ u
            zr = x[:, :, : 2 * HIDDEN] + hu[:, :, : 2 * HIDDEN]
            np.negative(zr, out=zr)
            with np.errstate(over="ignore"):  # a gate that is shut
                np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r = zr[:, :, :HIDDEN], zr[:, :, HIDDEN:]
            cand = r * hu[:, :, 2 * HIDDEN:]
            cand += x[:, :, 2 * HIDDEN:]
            np.tanh(cand, out=cand)
            change = (1 - z) * (cand - h)
            if keep or not (full[t] and full[back]):
                m = np.stack([mask[t], mask[back]])[:, :, None]
                change *= m
            if keep:
                kept.append((h, z, r, cand, hu[:, :, 2 * HIDDEN:], m))
            h = h + change
            states[t, :, :HIDDEN] = h[0]
            states[back, :, HIDDEN:] = h[1]
        th = np.tanh(states @ self.p["a"])
        e = np.where(mask, th @ self.p["v"], -1e9)
        e = np.exp(e - e.max(0))
        e /= e.sum(0)
        pooled = np.einsum("tn,tnh->nh", e, states)
        logit = pooled @ self.p["w"] + self.p["b"]
        return (logit, (states, th, e, pooled, kept)) if keep else logit

    def gradients(self, gates, ids, mask, target, weight) -> tuple[dict, np.ndarray, float]:
        logit, (states, th, e, pooled, kept) = self.forward(gates, ids, mask, True)
        p, (steps, n), g = self.p, ids.shape, {}
        prob = sigmoid(logit)
        loss = float((weight * -(target * np.log(prob + 1e-7) + (1 - target) * np.log(1 - prob + 1e-7))).sum() / weight.sum())
        d = (weight * (prob - target) / weight.sum()).astype(np.float32)
        g["b"], g["w"] = d.sum(keepdims=True), pooled.T @ d
        dpool = d[:, None] * p["w"]
        de = np.einsum("nh,tnh->tn", dpool, states)
        dscore = e * (de - (e * de).sum(0))
        dstates = e[:, :, None] * dpool
        g["v"] = np.einsum("tn,tna->a", dscore, th)
        dth = dscore[:, :, None] * p["v"] * (1 - th * th)
        g["a"] = np.einsum("tnh,tna->ha", states, dth)
        dstates += dth @ p["a"].T
        g["u"] = np.zeros_like(p["u"])
        moved = np.empty((2, steps, n, 3 * HIDDEN), np.float32)
        dh = np.zeros((2, n, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            back = steps - 1 - t
            h, z, r, cand, hun, m = kept[t]
            dh = dh + np.stack([dstates[t, :, :HIDDEN], dstates[back, :, HIDDEN:]])
            dnew = dh * m
            dz = dnew * (h - cand) * z * (1 - z)
            dc = dnew * (1 - z) * (1 - cand * cand)
            dr = dc * hun * r * (1 - r)
            dx = np.concatenate([dz, dr, dc], 2)
            dhu = np.concatenate([dz, dr, dc * r], 2)
            g["u"] += h.transpose(0, 2, 1) @ dhu
            dh = dh * (1 - m) + dnew * z + dhu @ p["u"].transpose(0, 2, 1)
            moved[0, t], moved[1, back] = dx[0], dx[1]
        order = np.argsort(ids, axis=None, kind="stable")
        present, at = np.unique(ids.reshape(-1)[order], return_index=True)
        dgates = np.zeros((len(gates[0]), 2, 3 * HIDDEN), np.float32)
        for side in (0, 1):
            dgates[present, side] = np.add.reduceat(moved[side].reshape(-1, 3 * HIDDEN)[order], at)
        return g, dgates, loss

    def fit(self, texts: list[list[bytes]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> None:
        """Adam over windows that carry their text's label; classes weigh alike to
        a root."""
        rng = np.random.default_rng(seed)
        index: dict[bytes, int] = {}
        flat = np.array([index.setdefault(w, len(index)) for t in texts for w in t], np.int64)
        own, grams, gram_owner = word_rows(list(index))
        gram_start = np.searchsorted(gram_owner, np.arange(len(own) + 1))
        lengths = np.array([len(t) for t in texts])
        owner, first = windows(lengths, WINDOW)
        base = np.cumsum(lengths) - lengths
        span = np.arange(WINDOW)
        share = max(labels.mean(), 1e-3)
        weights = np.where(labels[owner] > 0, ((1 - share) / share) ** 0.5, 1.0).astype(np.float32)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(owner))
            for at in range(0, len(order), BATCH):
                some = order[at: at + BATCH]
                place = first[some] + span[:, None]
                mask = place < lengths[owner[some]]
                ids = flat[np.minimum(base[owner[some]] + place, len(flat) - 1)]
                distinct, local = np.unique(ids, return_inverse=True)
                local = local.reshape(ids.shape)
                pick = np.concatenate([np.arange(gram_start[d], gram_start[d + 1]) for d in distinct])
                rows = (own[distinct], grams[pick], np.repeat(np.arange(len(distinct)), gram_start[distinct + 1] - gram_start[distinct]))
                x = self.inputs(rows)
                both = x @ self.p["wx"] + self.p["bx"]
                gates = both[:, : 3 * HIDDEN], both[:, 3 * HIDDEN:]
                g, dgates, _ = self.gradients(gates, local, mask, labels[owner[some]].astype(np.float32), weights[some])
                dgates = dgates.reshape(len(distinct), -1)
                g["wx"], g["bx"] = x.T @ dgates, dgates.sum(0)
                dx = dgates @ self.p["wx"].T
                g["word"], g["gram"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["gram"])
                np.add.at(g["word"], rows[0], dx[:, :DIM])
                np.add.at(g["gram"], rows[1], (dx[:, DIM:] / np.maximum(np.bincount(rows[2], minlength=len(distinct)), 1)[:, None])[rows[2]])
                step += 1
                rate = RATE * (1 - 0.8 * epoch / max(1, epochs - 1)) * (1 - 0.999 ** step) ** 0.5 / (1 - 0.9 ** step)
                for k, v in self.p.items():
                    a, b = moments[k]
                    a += 0.1 * (g[k] - a)
                    b += 0.001 * (g[k] * g[k] - b)
                    v -= (rate * (a / (np.sqrt(b) + 1e-8) + DECAY * v)).astype(np.float32) if k in ("word", "gram") else (rate * a / (np.sqrt(b) + 1e-8)).astype(np.float32)


@dataclass
class Model:
    network: Network
    #: Constant, weight of the highest and of the mean window logit; None: nothing to learn from.
    pool: np.ndarray | None
    #: Share of toxic documents in the sample.
    base: float
    #: Tells models apart in a worker.
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def document_scores(self, texts: list[str | None], memo: ProjectedWords | None = None) -> np.ndarray:
        if self.pool is None:
            return np.full(len(texts), self.base)
        memo = memo or ProjectedWords(self.network)
        top, mean, some = document_logits(self.network, [model_words(t) for t in texts], memo)
        return np.where(some, sigmoid(self.pool[0] + self.pool[1] * top + self.pool[2] * mean), self.base)


class ProjectedWords:
    """Gate inputs of the words met so far, up to a bound."""

    def __init__(self, network: Network) -> None:
        self.network, self.index = network, {}
        self.gates = tuple(np.zeros((0, 3 * HIDDEN), np.float32) for _ in range(2))

    def ids(self, texts: list[list[bytes]]) -> np.ndarray:
        index = self.index
        new = list({w for t in texts for w in t if w not in index})
        if index and len(index) + len(new) > PROJECTED_WORDS:
            index.clear()
            new = list({w for t in texts for w in t})
        if new:
            n = len(index)
            if n + len(new) > len(self.gates[0]):
                self.gates = tuple(np.concatenate([g[:n], np.empty((n + 2 * len(new), 3 * HIDDEN), np.float32)]) for g in self.gates)
            for table, more in zip(self.gates, self.network.project(word_rows(new))):
                table[n: n + len(new)] = more
            index.update(zip(new, range(n, n + len(new))))
        return np.array([index[w] for t in texts for w in t], np.int64)


def document_logits(network: Network, texts: list[list[bytes]], memo: ProjectedWords, step: int = 1024):
    """Each text's highest and mean window logit, and whether it has windows."""
    lengths = np.array([len(t) for t in texts], np.int64)
    owner, first = windows(lengths)
    n = len(texts)
    top, total, count = np.full(n, -np.inf), np.zeros(n), np.bincount(owner, minlength=n)
    if len(owner):
        flat = memo.ids(texts)
        base = np.cumsum(lengths) - lengths
        for at in range(0, len(owner), step):
            own, begin = owner[at: at + step], first[at: at + step]
            place = begin + np.arange(WINDOW)[:, None]
            mask = place < lengths[own]
            logit = network.forward(memo.gates, flat[np.minimum(base[own] + place, len(flat) - 1)], mask)
            np.maximum.at(top, own, logit)
            np.add.at(total, own, logit)
    some = count > 0
    return np.where(some, top, 0.0), total / np.maximum(count, 1), some


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Newton's method; the constant is the first column of ``x``."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(hess, x.T @ (p - y) + ridge * w)
    return w


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS) -> Model:
    """The network on four fifths of the sample's texts, the pooling weights on the
    rest, so that these see logits as new texts have them."""
    network = Network()
    words = [model_words(t) for t in texts]
    part = np.arange(len(texts)) % 5 == 0
    fit = [k for k in range(len(texts)) if words[k] and (not part[k] or len(texts) < 100)]
    if not fit or not len(labels) or labels.min() == labels.max():
        return Model(network, None, float(labels.mean()) if len(labels) else 0.0)
    network.fit([words[k] for k in fit], labels[fit], epochs)
    rest = [k for k in range(len(texts)) if words[k] and (part[k] or len(texts) < 100)]
    top, mean, _ = document_logits(network, [words[k] for k in rest], ProjectedWords(network))
    return Model(network, logistic(np.column_stack([np.ones(len(rest)), top, mean]), labels[rest].astype(float)), float(labels.mean()))


#: Characters that a window of words needs at least.
LEAST_CHARS = 64


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most ``limit`` labelled ids that are not held out, by the
    hash of their ids, and at most ``chars`` characters. Conflicting labels of an id
    count as toxic; of the texts of a repeated id the shortest is taken, before
    anything reaches the driver. Texts that do not fit are passed over; if none of a
    label fits, the beginning of its shortest one stands for it."""
    allowed = labels.where(crc_mod("doc_id", HELD_OUT) != 0).where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = few_by_hash(allowed, ["doc_id"], limit, allowed.count())
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    one = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min(F.struct(F.length("text").alias("n"), "text")).alias("least"))
    one = one.select("doc_id", "toxic", "least.n", "least.text")
    sized = one.select("doc_id", "n", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    take, total = [], 0
    for r in sized:
        if total + r["n"] <= chars:
            total += r["n"]
            take.append(r)
    lost = sorted({r["toxic"] for r in sized} - {r["toxic"] for r in take})
    if lost and chars < LEAST_CHARS:
        raise ValueError(f"a sample of {chars} characters does not hold a window")
    for label in lost:
        take.append(min((r for r in sized if r["toxic"] == label), key=lambda r: r["n"]))
    if not take:
        return [], np.zeros(0)
    kept = one.where(F.col("doc_id").isin([r["doc_id"] for r in take])).select("doc_id", F.substring("text", 1, chars).alias("text"))
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    return [texts[r["doc_id"]] for r in take], np.array([r["toxic"] for r in take], float)


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    return train(*labelled_sample(docs, labels))


def score_toxicity(df: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, ``score`` and ``predicted`` of every row's whole text."""
    return named(_scored(df, model, keep), keep)


def _scored(df: DataFrame, model: Model, keep: tuple[str, ...]) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        own = shared.value
        memo = held(("toxicity", own.key), lambda: ProjectedWords(own.network))
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                score = own.document_scores(b.column(len(keep)).to_pylist(), memo)
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(len(keep))], pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], [*b.schema.names[: len(keep)], "score", "predicted"])

    return with_text(df, keep, "text", "score double, predicted int", run)


def without_toxic(df: DataFrame, model: Model) -> DataFrame:
    """The rows that are not predicted toxic, with all their columns."""
    keep = tuple(df.columns)
    return named(_scored(df, model, keep).where("predicted = 0"), keep, results=False)
