"""LM scoring with a log-bilinear model trained by noise-contrastive estimation.

Three passes over the texts, each a scan:

1. token counts of the training texts (c, N, V), one aggregation by token;
2. training: every task turns its training texts into counted (two words back,
   one word back, word) triples and runs NCE on all of them in numpy minibatches;
   tasks send what they changed in the words they saw, which is averaged by word;
3. scoring: batched matrix products give each context's two normalisers, over the
   blocks of words and over the words of a block, so token log-probabilities are
   normalised at a cost of the square root of the vocabulary.

The model's words are all tokens that occur LEAST times in training, so they grow with
the corpus, up to MEMO; with the other frequent tokens they travel as broadcasts of
bounded size. All words that the model lacks are one class, and such a word has its
smoothed share of the class's count. Rarer tokens of the scored texts meet their counts
by a join on the token.

Tokens are words (A-Z lowered) and an end, which is the empty token here.
Defined results: null and empty texts are one end; a null doc_id counts as the
empty text for the split; repeated rows are scored and counted each; without
training rows every token has probability 1 / (0 + 0 + 1) in the base. A very long text
is a step of its own and is scored whole; columns other than doc_id and text are not
read, so their names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, map_rows, steps, written

END = b""
#: Frequent tokens sent to the tasks at most; the model's own words occur so often.
MEMO, LEAST = 1 << 16, 5
#: Words of a block, by frequency; the blocks are the upper level of the normaliser.
BLOCK = 256
DIM, NOISE, NOISE_DRAWS, BATCH, RATE, EPOCHS, SEED = 16, 3, 32, 4096, 0.1, 1, 23
#: A task's changes to a word weigh by its occurrences there and this part of the
#: occurrences that the task's share of the corpus would have.
SHARE = 1.0
HELD_OUT, HELD_OUT_REST = 7, 2
COUNTED = 400_000
STEP_CHARS = 4 << 20
#: Rows that numpy handles at once where a matrix of a few hundred kB, which stays in the
#: cache, is worked on several times.
ROWS = 512
#: Bytes of training text between two rounds of NCE in a task.
TRAIN_CHARS = 16 << 20


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % HELD_OUT == HELD_OUT_REST


def tokens_of(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct tokens of the texts, the end first; every token's number in text
    order, an end behind each text; the texts' token counts."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    owner = np.repeat(np.arange(len(texts)), words.value_lengths().to_numpy())
    flat = words.flatten()
    # white space at either end of a text leaves an empty piece there
    real = pc.greater(pc.binary_length(flat), 0)
    found = flat.filter(real).dictionary_encode()
    owner = owner[real.to_numpy(zero_copy_only=False)]
    number = np.zeros(len(owner) + len(texts), np.int64)
    number[np.arange(len(owner)) + owner] = found.indices.to_numpy() + 1
    return [END, *found.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()], number, np.bincount(owner, minlength=len(texts)) + 1


def token_counts(train: DataFrame) -> DataFrame:
    """(token, c) over all whole texts, the end included."""
    def run(batches: Iterator[pa.RecordBatch]):
        forget()
        counts: Counter[bytes] = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])

        for whole in batches:
            for b in steps(whole, 0, STEP_CHARS):
                tokens, number, _ = tokens_of(b.column(0))
                for t, n in zip(tokens, np.bincount(number, minlength=len(tokens)).tolist()):
                    counts[t] += n
                if len(counts) >= COUNTED:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    return map_rows(train, ["text"], "token binary, n long", run).groupBy("token").agg(F.sum("n").alias("c"))


@dataclass
class Frequent:
    """The most frequent tokens; the model's words come first, the end at 0."""
    tokens: list[bytes]
    counts: np.ndarray
    words: int
    n: int
    v: int

    @classmethod
    def of(cls, counts: DataFrame, memo: int = MEMO, least: int = LEAST) -> Frequent:
        """Whole bars of a histogram of counts from the top down; of the bar that does
        not fit, the tokens with the least hashes. Only those tokens come to the driver:
        the histograms have at most 64 * 64 bars and 4,096 buckets."""
        bar, bucket = F.floor(F.log2("c") * 64).cast("int"), F.pmod(F.xxhash64("token"), F.lit(1 << 12)).cast("int")
        bars = counts.groupBy(bar.alias("bar")).agg(F.count("*").alias("v"), F.sum("c").alias("n")).collect()
        n, v = sum(b["n"] for b in bars), sum(b["v"] for b in bars)
        room, edge = memo, None
        for b in sorted(bars, key=lambda b: -b["bar"]):
            if room < b["v"]:
                edge = b["bar"]
                break
            room -= b["v"]
        chosen = F.lit(True)
        if edge is not None:
            cut = 0
            for r in counts.where(bar == edge).groupBy(bucket.alias("bucket")).count().orderBy("bucket").collect():
                room -= r["count"]
                if room < 0:
                    break
                cut = r["bucket"] + 1
            chosen = (bar > edge) | ((bar == edge) & (bucket < cut))
        found = {bytes(r["token"]): r["c"] for r in counts.where((F.length("token") == 0) | chosen).collect()}
        end = found.pop(END, 0)
        top = [(END, end), *sorted(found.items(), key=lambda t: (-t[1], t[0]))]
        return cls([t for t, _ in top], np.array([c for _, c in top], np.int64), 1 + sum(c >= least for _, c in top[1:]), n, v)


class Model:
    """Class 0 is every word that the model lacks; class i + 1 is frequent token i. After
    words (w2, w1), with h = k1 * R[w1] + k2 * R[w2], block j has score h . C[j] + d[j]
    among the blocks, and class w has h . Q[w] + b[w] within its block."""

    def __init__(self, frequent: Frequent) -> None:
        self.size = k = frequent.words + 1
        own = frequent.counts[: frequent.words]
        self.counts = np.concatenate([[max(frequent.n - own.sum(), 0)], own])
        share = (self.counts + 1.0) / (self.counts + 1.0).sum()
        self.starts = np.arange(0, k, BLOCK)
        self.blocks = len(self.starts)
        block_share = np.add.reduceat(share, self.starts)
        #: running sums of the classes' shares, and every class's log share of its block
        self.upto = np.concatenate([[0.0], np.cumsum(share)])
        self.log_own = np.log(share) - np.log(np.repeat(block_share, np.diff([*self.starts, k])))
        self.log_block = np.log(block_share)
        rng = np.random.default_rng(SEED)
        draw = lambda n: rng.standard_normal((n, DIM)) * 0.1
        self.p = {"r": draw(k), "q": draw(k), "b": self.log_own.copy(), "c": draw(self.blocks), "d": self.log_block.copy(), "k": np.ones((2, DIM)) * [[0.7], [0.3]]}

    def copy(self) -> Model:
        other = Model.__new__(Model)
        other.__dict__.update(self.__dict__, p={n: x.copy() for n, x in self.p.items()})
        return other

    @property
    def cells(self) -> np.ndarray:
        """All parameters as rows of equal width: a word each, a block each, the mix."""
        p = self.p
        out = np.zeros((self.size + self.blocks + 1, 2 * DIM + 1))
        out[: self.size] = np.concatenate([p["r"], p["q"], p["b"][:, None]], 1)
        out[self.size: -1, : DIM + 1] = np.concatenate([p["c"], p["d"][:, None]], 1)
        out[-1, : 2 * DIM] = p["k"].reshape(-1)
        return out

    def load(self, cells: np.ndarray) -> None:
        own, blocks = cells[: self.size], cells[self.size: -1]
        self.p = {"r": own[:, :DIM].copy(), "q": own[:, DIM: 2 * DIM].copy(), "b": own[:, -1].copy(),
                  "c": blocks[:, :DIM].copy(), "d": blocks[:, DIM].copy(), "k": cells[-1, : 2 * DIM].reshape(2, DIM).copy()}

    def context(self, w2: np.ndarray, w1: np.ndarray) -> np.ndarray:
        return self.p["r"][w1] * self.p["k"][0] + self.p["r"][w2] * self.p["k"][1]

    def log_prob(self, w2: np.ndarray, w1: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Natural log-probabilities of classes after two words. The normaliser of the
        blocks is one a context, that of a block's words one a block and context."""
        k = self.size
        keys, where = np.unique((w // BLOCK * k * k + w1 * k + w2) * BLOCK + w % BLOCK, return_inverse=True)
        # by block and context, so that the rows of either lie together
        rows, inside = np.divmod(keys, BLOCK)
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        block, pairs = np.divmod(rows[first], k * k)
        pairs, of = np.unique(pairs, return_inverse=True)
        h = np.ones((len(pairs), DIM + 1), np.float32)
        for at in range(0, len(pairs), ROWS):
            some = pairs[at: at + ROWS]
            h[at: at + ROWS, :-1] = self.context(some % k, some // k)
        reach = float(np.sqrt(np.einsum("nd,nd->n", h, h).max(initial=0)))
        heads, calm = scorer(self.p["c"], self.p["d"], reach)
        over = np.empty(len(pairs), np.float32)
        for at in range(0, len(pairs), ROWS):
            over[at: at + ROWS] = log_sums(h[at: at + ROWS] @ heads, calm)
        out = np.empty(len(keys))
        ends = np.searchsorted(block, np.arange(1, self.blocks + 1))
        first = np.append(first, len(keys))
        at = 0
        for j, end in enumerate(ends.tolist()):
            if at == end:
                continue
            lo = j * BLOCK
            tails, calm = scorer(self.p["q"][lo: lo + BLOCK], self.p["b"][lo: lo + BLOCK], reach)
            while at < end:
                stop = min(end, at + ROWS)
                mine = h.take(of[at: stop], 0)
                scores = mine @ tails
                s, times = slice(first[at], first[stop]), np.diff(first[at: stop + 1])
                own = scores[np.repeat(np.arange(len(mine)), times), inside[s]].astype(np.float64)
                whole = mine @ heads[:, j] - over.take(of[at: stop]).astype(np.float64) - log_sums(scores, calm)
                out[s] = own + np.repeat(whole, times)
                at = stop
        return out[where]

    def train(self, triples: np.ndarray, counts: np.ndarray, rng: np.random.Generator, squares: dict) -> None:
        """NCE by Adagrad on counted triples (one number each), for the block among all
        blocks and for the word within its block, with noise from the shares of each."""
        k, p = self.size, self.p
        block_upto = np.concatenate([[0.0], np.cumsum(np.exp(self.log_block))])
        noise_of = Noise(self)
        for _ in range(EPOCHS):
            order = rng.permutation(len(triples))
            for at in range(0, len(order), BATCH):
                some = order[at: at + BATCH]
                t, weight = triples[some], counts[some] / counts[some].sum()
                w2, w1, w = t // (k * k), t // k % k, t % k
                back1, back2 = p["r"].take(w1, 0), p["r"].take(w2, 0)
                block, h = w // BLOCK, back1 * p["k"][0] + back2 * p["k"][1]
                drawn = np.searchsorted(block_upto, rng.random(NOISE_DRAWS) * block_upto[-1], "right") - 1
                dh = self.block_step(h, block, np.minimum(drawn, self.blocks - 1), weight, squares)
                noise = noise_of(block, rng.random((len(some), NOISE)))
                dh += self.step(h, w, noise, weight, "q", "b", self.log_own, squares)
                mixed = np.stack([np.einsum("nd,nd->d", dh, back1), np.einsum("nd,nd->d", dh, back2)])
                moves = p["k"].T[:, :, None] * np.ascontiguousarray(dh.T)[:, None]
                rows, g = summed(np.concatenate([w1, w2]), moves.reshape(DIM, -1), k)
                ascend(p["r"], squares["r"], rows, upright(g))
                ascend(p["k"], squares["k"], np.arange(2), mixed)

    def block_step(self, h, target, drawn, weight, squares: dict) -> np.ndarray:
        """The same among the blocks, with noise that the rows of a minibatch share; a
        block that was drawn several times is scored once."""
        c, d = self.p["c"], self.p["d"]
        free = d - np.log(NOISE) - self.log_block
        own, (kinds, times) = c.take(target, 0), np.unique(drawn, return_counts=True)
        up = weight * (1 - sigmoid(np.einsum("nd,nd->n", h, own) + free[target]))
        down = sigmoid(h @ c[kinds].T + free[kinds]) * (weight[:, None] * (times * (NOISE / len(drawn))))
        dh = up[:, None] * own - down @ c[kinds]
        push = np.concatenate([np.ascontiguousarray(h.T) * up, up[None]])
        *g, bias = (np.bincount(target, x, minlength=self.blocks) for x in push)
        g = upright(g)
        g[kinds] -= down.T @ h
        bias[kinds] -= down.sum(0)
        ascend(c, squares["c"], np.arange(self.blocks), g)
        ascend(d, squares["d"], np.arange(self.blocks), bias)
        return dh

    def step(self, h, target, noise, weight, out: str, bias: str, log_share_of, squares: dict) -> np.ndarray:
        """One minibatch against its noise classes; the gradient for the contexts."""
        q, b = self.p[out], self.p[bias]
        free = lambda x: b.take(x) - np.log(NOISE) - log_share_of.take(x)
        own, drawn = q.take(target, 0), q.take(noise, 0)
        up = weight * (1 - sigmoid(np.einsum("nd,nd->n", h, own) + free(target)))
        down = sigmoid(np.einsum("nd,nkd->nk", h, drawn) + free(noise)) * weight[:, None]
        dh = up[:, None] * own - np.einsum("nk,nkd->nd", down, drawn)
        push = np.concatenate([up[None], -down.T])
        moves = np.empty((DIM + 1, *push.shape))
        np.multiply(np.ascontiguousarray(h.T)[:, None], push, out=moves[:-1])
        moves[-1] = push
        rows, g = summed(np.concatenate([target[None], noise.T]).reshape(-1), moves.reshape(DIM + 1, -1), len(q))
        ascend(q, squares[out], rows, upright(g[:-1]))
        ascend(b, squares[bias], rows, g[-1])
        return dh


class Noise:
    """Classes of given blocks by their shares. A block's share is cut into as many equal
    cells as it may have words; a table has the class where each cell begins, and the
    classes behind it are tried one by one, the last few draws by binary search."""

    def __init__(self, model: Model) -> None:
        self.lo, self.hi = model.starts, np.minimum(model.starts + BLOCK, model.size)
        self.upto = np.concatenate([model.upto, [np.inf]])
        self.begin, self.span = model.upto[self.lo], model.upto[self.hi] - model.upto[self.lo]
        self.first = self.find(self.begin[:, None] + np.arange(BLOCK) / BLOCK * self.span[:, None]).reshape(-1)

    def find(self, x: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.upto, x, "right") - 1

    def __call__(self, block: np.ndarray, u: np.ndarray) -> np.ndarray:
        x = (self.begin.take(block)[:, None] + u * self.span.take(block)[:, None]).reshape(-1)
        out = self.first.take(((u * BLOCK).astype(np.int64) + (block * BLOCK)[:, None]).reshape(-1))
        late = np.flatnonzero(self.upto.take(out + 1) <= x)
        for _ in range(2):
            out[late] += 1
            late = late[self.upto.take(out[late] + 1) <= x[late]]
        out[late] = self.find(x[late])
        return np.clip(out.reshape(u.shape), self.lo.take(block)[:, None], self.hi.take(block)[:, None] - 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    y = np.clip(x, -30, 30)
    np.exp(np.negative(y, out=y), out=y)
    y += 1
    return np.reciprocal(y, out=y)


def scorer(x: np.ndarray, bias: np.ndarray, reach: float) -> tuple[np.ndarray, bool]:
    """The matrix that turns contexts with a 1 behind them into scores; and whether the
    largest score of any context that is no longer than reach is a small number."""
    calm = abs(bias.max()) + reach * np.sqrt((x ** 2).sum(1).max()) < 60
    return np.concatenate([x, bias[:, None]], 1).T.astype(np.float32), bool(calm)


def log_sums(s: np.ndarray, calm: bool) -> np.ndarray:
    """Log of each row's sum of exponentials, in the place of the scores."""
    if calm:
        return np.log(np.exp(s, out=s).sum(1))
    high = s.max(1)
    s -= high[:, None]
    return high + np.log(np.exp(s, out=s).sum(1))


def summed(index: np.ndarray, x: np.ndarray, size: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct indices below size, and for each row of x the sums by index."""
    met = np.zeros(size, bool)
    met[index] = True
    rows = np.flatnonzero(met)
    number = np.empty(size, np.int64)
    number[rows] = np.arange(len(rows))
    where = number.take(index)
    return rows, [np.bincount(where, y, minlength=len(rows)) for y in x]


def upright(columns: list[np.ndarray]) -> np.ndarray:
    return np.stack(columns, 1)


def ascend(x: np.ndarray, squares: np.ndarray, rows: np.ndarray, g: np.ndarray) -> None:
    for at in range(0, len(rows), ROWS):
        some, up = rows[at: at + ROWS], g[at: at + ROWS]
        s = up * up
        s += squares.take(some, 0)
        squares[some] = s
        np.sqrt(s, out=s)
        s += 1e-4
        np.divide(up, s, out=s)
        s *= RATE
        s += x.take(some, 0)
        x[some] = s


def classes(texts: pa.Array, index: dict[bytes, int], words: int) -> tuple[list[bytes] | np.ndarray, ...]:
    """The distinct tokens; flat arrays over all tokens of the texts: number among the
    distinct ones, memo index or -1, class, class of one back, class of two back (before a
    text: ends); and the texts' token counts."""
    tokens, number, sizes = tokens_of(texts)
    found = np.array([index.get(t, -1) for t in tokens], np.int64)[number]
    kind = np.where((found >= 0) & (found < words), found + 1, 0)
    starts = np.cumsum(sizes) - sizes
    back1 = np.concatenate([[1], kind[:-1]])
    back2 = np.concatenate([[1, 1], kind[:-2]])[: len(kind)]
    back1[starts] = back2[starts] = 1
    back2[(starts + 1)[sizes > 1]] = 1
    return tokens, number, found, kind, back1, back2, sizes


def trained(train: DataFrame, frequent: Frequent) -> Model:
    """All training texts, each task from the same start. A task sends its changes to the
    words that it saw, to the blocks and to the mix; a word's changes are averaged with
    the weights of SHARE. What comes back is one row a word."""
    model = Model(frequent)
    if not frequent.n:
        return model
    index = {t: i for i, t in enumerate(frequent.tokens[: frequent.words])}
    shared = train.sparkSession.sparkContext.broadcast((model, index))
    width = 2 * DIM + 1

    def run(batches: Iterator[pa.RecordBatch]):
        start, number = shared.value
        own, k = start.copy(), start.size
        squares = {n: np.zeros_like(x) for n, x in own.p.items()}
        rng = np.random.default_rng(SEED + TaskContext.get().partitionId())
        seen = np.zeros(k)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def learn():
            keys, where = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
            own.train(keys, np.bincount(where, np.concatenate([c for _, c in held])), rng, squares)
            held.clear()

        for whole in batches:
            for b in steps(whole, 0, STEP_CHARS):
                _, _, _, w, w1, w2, _ = classes(b.column(0), number, len(number))
                held.append(np.unique((w2 * k + w1) * k + w, return_counts=True))
                seen += np.bincount(w, minlength=k)
                size += STEP_CHARS
                if size >= TRAIN_CHARS:
                    learn()
                    size = 0
        if held:
            learn()
        tokens = seen.sum()
        if tokens:
            weight = np.concatenate([seen + SHARE * start.counts * (tokens / frequent_n), np.full(start.blocks + 1, tokens)])
            some = np.flatnonzero(np.concatenate([seen, np.ones(start.blocks + 1)]))
            change = (own.cells[some] - start.cells[some]).astype(np.float32)
            for at in range(0, len(some), 4096):
                x = change[at: at + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(some[at: at + 4096], pa.int32()), pa.array(weight[some[at: at + 4096]]),
                                                  pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, width), pa.int32()), pa.array(x.reshape(-1)))], ["cell", "weight", "x"])

    frequent_n = float(frequent.n)
    moved = map_rows(train, ["text"], "cell int, weight double, x array<float>", run)
    rows = moved.groupBy("cell").agg(F.array(*[F.sum(F.col("x")[i] * F.col("weight")) for i in range(width)]).alias("x")).toPandas()
    if len(rows):
        whole = np.concatenate([(1 + SHARE) * model.counts, np.full(model.blocks + 1, frequent_n)])
        at = rows["cell"].to_numpy()
        cells = model.cells
        cells[at] += np.stack(rows["x"].to_numpy()) / np.maximum(whole[at], 1)[:, None]
        model.load(cells)
    return model


def fit_lm(docs: DataFrame) -> tuple[DataFrame, Frequent, Model]:
    """Token counts, the frequent tokens and the model of the rows that are not held out."""
    train = docs.where(~held_out()).select("text")
    counts = written(token_counts(train), "token-counts")
    frequent = Frequent.of(counts)
    return counts, frequent, trained(train, frequent)


def lm_scores(df: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for
    every whole text."""
    docs = df.select("doc_id", "text", held_out().alias("held_out"))
    counts, frequent, model = fit_lm(df.select("doc_id", "text"))
    shared = df.sparkSession.sparkContext.broadcast((frequent, model))
    id_kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        top, net = shared.value
        index = {t: i for i, t in enumerate(top.tokens)}
        logs = np.log10(top.counts + 1.0)
        own_n = int(top.counts[: top.words].sum())
        rest = np.log10(top.n - own_n + top.v - int((top.counts[: top.words] > 0).sum()) + 1)
        whole_log = np.log10(top.n + top.v + 1)
        mark = TaskContext.get().partitionId() << 40
        for whole in batches:
            for b in steps(whole, 1, STEP_CHARS):
                tokens, number, found, w, w1, w2, sizes = classes(b.column(1), index, top.words)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                score = net.log_prob(w2, w1, w)
                score /= np.log(10)
                memo = found >= 0
                own_log = np.where(memo, logs[np.maximum(found, 0)], 0.0)
                score += np.where(w == 0, own_log - rest, 0.0)
                n = len(sizes)
                per_doc = [pa.array(np.bincount(owner, x, minlength=n), t) for x, t in ((memo & (top.counts[np.maximum(found, 0)] > 0), pa.float64()), (own_log - whole_log, pa.float64()), (score, pa.float64()))]
                keys = mark + np.arange(n)
                mark += n
                # a text's own row travels under a token that no text has, so that all rows go one way
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([b" %d" % x for x in keys], pa.binary()), pa.array(np.zeros(n, np.int32)), b.column(0), b.column(2), pa.array(sizes), *per_doc], NAMES)
                rare, times = np.unique(owner[~memo] * len(tokens) + number[~memo], return_counts=True)
                of, which = np.divmod(rare, len(tokens))
                spare = [pa.nulls(len(rare), f) for f in (b.column(0).type, b.column(2).type, pa.int64(), pa.float64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(keys[of]), pa.array(tokens, pa.binary()).take(pa.array(which)), pa.array(times.astype(np.int32)), *spare], NAMES)

    rows = map_rows(docs, ["doc_id", "text", "held_out"], f"key long, token binary, n int, doc_id {id_kind}, held_out boolean, n_tokens long, known double, base double, own double", run)
    met = rows.join(counts, "token", "left")
    more = F.coalesce(F.sum(F.col("n") * F.log10(F.col("c") + 1.0)), F.lit(0.0))
    return met.groupBy("key").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        (F.max("known").cast("long") + F.coalesce(F.sum(F.when(F.col("c").isNotNull(), F.col("n"))), F.lit(0))).alias("n_known"),
        F.lit(frequent.n).cast("long").alias("train_tokens"), (F.max("base") + more).alias("base_score"), (F.max("own") + more).alias("score")).drop("key")


NAMES = ["key", "token", "n", "doc_id", "held_out", "n_tokens", "known", "base", "own"]
