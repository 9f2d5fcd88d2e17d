"""Periodic runs: a suffix automaton whose link tree is accessed word by word.

For the words before each position the automaton's states on the way to the root are
all suffixes that end there, each with the place where it occurred last. A link-cut
tree keeps those places: appending a word accesses its state, which makes the way to
the root one preferred path and recolours it with the new place. The old path segments
met on the way say, longest suffix first, "this suffix of length L ended last at e".
With d = place - e and L >= d, the words from place - L - d on have period d: a square.
L >= 3 d is a stretch of exponent four; it is extended in both directions to its run.

Why nothing is missed: in a run of smallest period q and length 4 q or more, the suffix
of length 3 q at the 4 q-th word has occurred last exactly q words earlier, as an
occurrence closer by would give the run a smaller period (Fine and Wilf). For the same
reason every d found is the smallest period. Maximal stretches of one period overlap in
less than a period, so a stretch that ends within the last run of its period is known.

A word of such a run occurs four times in it. Words that occur less often, in the text
or in the stretch that is left of it, are cut out first, over and over until none are
left; only what remains enters the automaton, with the rest as boundaries. The state of
a text grows with its longest such stretch and nothing else.

Defined results: words are runs of other characters than blank and tab to carriage
return, as they are; null, empty and blank texts have no words and no runs; ties for
the greatest run go to the smallest start, then period (periods of one stretch never
tie); repeated rows and null ids each give their own row, and a null id is never
respliced; an empty table gives no rows; only id and text are read, so other columns
clash with nothing; long texts are handled whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, map_rows

#: A run has at least so many words, and so many of its periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4


class Automaton:
    """The suffix automaton of a sequence of numbers: ``longest`` word count, suffix
    ``link`` of each state, and the state of every prefix. State 0 is the root."""

    def __init__(self, words: list[int]) -> None:
        self.longest, self.link, self.prefix = [0], [-1], []
        longest, link = self.longest, self.link
        moves: list[dict[int, int]] = [{}]
        last = 0
        for w in words:
            new = len(longest)
            longest.append(longest[last] + 1)
            link.append(0)
            moves.append({})
            p = last
            while p >= 0 and w not in moves[p]:
                moves[p][w] = new
                p = link[p]
            if p >= 0:
                q = moves[p][w]
                if longest[q] == longest[p] + 1:
                    link[new] = q
                else:  # q also holds longer words; the shorter ones get a state of their own
                    twin = len(longest)
                    longest.append(longest[p] + 1)
                    link.append(link[q])
                    moves.append(moves[q].copy())
                    while p >= 0 and moves[p].get(w) == q:
                        moves[p][w] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
            self.prefix.append(new)


class LastPlaces:
    """A link-cut tree over a tree of parents. Every preferred path is a splay tree by
    depth with one colour, kept at its root: the place that accessed it last."""

    def __init__(self, parents: list[int]) -> None:
        # numbers are moved up by one, so that 0 is "none"
        self.up = [0] + [p + 1 for p in parents]
        self.left, self.right = [0] * len(self.up), [0] * len(self.up)
        self.colour = [-1] * len(self.up)

    def splay(self, x: int) -> None:
        """Makes ``x`` the root of its path's splay tree; the colour moves with it."""
        up, left, right, colour = self.up, self.left, self.right, self.colour
        while True:
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                return
            g = up[p]
            if not g or (left[g] != p and right[g] != p):
                colour[x] = colour[p]
                self._rotate(x)
                return
            over = up[g]
            if not over or (left[over] != g and right[over] != g):
                colour[x] = colour[g]
            self._rotate(p if (left[g] == p) == (left[p] == x) else x)
            self._rotate(x)

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b:
            up[b] = p
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x
        up[x], up[p] = g, x

    def access(self, v: int, place: int) -> list[tuple[int, int]]:
        """(deepest state, colour) of the path segments from ``v`` to the root, which
        from now on are one path of colour ``place``."""
        up, right, colour = self.up, self.right, self.colour
        x, below, met = v + 1, 0, []
        while x:
            self.splay(x)
            met.append((x - 1, colour[x]))
            if rest := right[x]:
                colour[rest] = colour[x]  # what hangs below stays a path of the old colour
            right[x] = below
            below, x = x, up[x]
        self.splay(v + 1)
        colour[v + 1] = place
        return met


def leading(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading elements are equal, looked at in growing blocks."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        other = np.flatnonzero(a[at: min(at + step, n)] != b[at: min(at + step, n)])
        if other.size:
            return at + int(other[0])
        at, step = at + step, step * 2
    return n


#: Rounds of cutting; stretches that still shrink then go on as they are.
ROUNDS = 12


def stretches(words: np.ndarray) -> list[tuple[int, int]]:
    """Stretches outside which no word can be in a run: in a run every word occurs
    LEAST_PERIODS times."""
    todo, out = [(0, len(words), 0)], []
    while todo:
        lo, hi, rounds = todo.pop()
        if hi - lo < LEAST_WORDS:
            continue
        own = words[lo:hi]
        often = np.bincount(own)[own] >= LEAST_PERIODS
        if often.all() or rounds == ROUNDS:
            out.append((lo, hi))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], often.view(np.int8), [0]])))
        todo += [(lo + a, lo + b, rounds + 1) for a, b in edges.reshape(-1, 2).tolist() if b - a >= LEAST_WORDS]
    return out


def stretch_runs(words: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of the runs, by the automaton and its accesses."""
    automaton = Automaton(words.tolist())
    places, longest = LastPlaces(automaton.link), automaton.longest
    known: dict[int, int] = {}  # the end of the last run of each period
    for place, state in enumerate(automaton.prefix):
        for deepest, before in places.access(state, place):
            period = place - before
            length = longest[deepest]
            if before < 0 or length < (LEAST_PERIODS - 1) * period or known.get(period, 0) > place:
                continue
            start = place - length - period + 1
            end = place + 1 + leading(words[place + 1:], words[place + 1 - period:])
            if start:
                start -= leading(words[start - 1::-1], words[start + period - 1::-1])
            known[period] = end
            if end - start >= LEAST_WORDS:
                yield start, end - start, period


def runs_of(words: list) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of a list of words, by start, then period."""
    if len(words) < LEAST_WORDS:
        return []
    number: dict = {}
    of_word = np.array([number.setdefault(w, k) for k, w in enumerate(words)], np.int64)
    out = [(lo + s, length, period) for lo, hi in stretches(of_word) for s, length, period in stretch_runs(renumbered(of_word[lo:hi]))]
    return sorted(out, key=lambda r: (r[0], r[2]))


def renumbered(words: np.ndarray) -> np.ndarray:
    return np.unique(words, return_inverse=True)[1].astype(np.int64)


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run repeats: all of it after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period: start + length] = False
    return [words[k] for k in np.flatnonzero(keep).tolist()]


def periodic_runs(df: DataFrame, key: str = "doc_id", text: str = "text", change: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Per row: ``key``, runs (an array of start, length, period by start, then period)
    and collapsed (the words that no run repeats, joined by a space). ``change`` may
    alter a row's words before."""
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]):
        forget()
        for b in batches:
            found, texts = [], []
            for own, t in zip(b.column(0).to_pylist(), b.column(1)):
                words = t.as_py().encode().split() if t.is_valid else []
                words = change(own, words) if change else words
                runs = runs_of(words)
                found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                texts.append(b" ".join(collapsed(words, runs)).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(item)), pa.array(texts, pa.string())], [key, "runs", "collapsed"])

    kind = df.schema[key].dataType.simpleString()
    return map_rows(df, [key, text], f"`{key}` {kind}, runs array<struct<start long, length long, period long>>, collapsed string", run)


def spliced(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents repeat a part of themselves to the end: with h the
    crc32 of the decimal id and g = h // 10, words from g % n on are a period of a
    (3 + g % 8)-th of the rest. Other documents and null ids stay as they are."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a: a + p]
    return words[:a] + (part * ((n - a) // p + 1))[: n - a]


def run_digest(runs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row of :func:`periodic_runs`: the number of runs, the greatest one and the
    digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string"))), "\n")
    return runs.withColumn("_b", best).select(
        key, F.size("runs").cast("long").alias("n_runs"), (-F.col("_b.start")).alias("start"), F.col("_b.length").alias("length"), (-F.col("_b.period")).alias("period"),
        F.expr("1000 * _b.length div -_b.period").alias("exponent_milli"),
        F.sha2(F.concat(lines, F.when(F.size("runs") > 0, "\n").otherwise("")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
