"""Benchmark decontamination with suffix arrays over the training documents.

Every task indexes its batch of training words as a shard: a suffix array over
word numbers, sorted by prefix doubling up to the longest item. Every suffix of
every benchmark item is binary-searched in every shard, which gives its longest
verbatim match and the places of it; suffixes that match for a whole window
(13 words, or a shorter item as a whole) mark the words they cover.

A training suffix can only matter if its next words are all words that the
benchmark has, for as long as the shortest window; others are not indexed, which
loses no match and keeps the arrays small.

The benchmark travels to the tasks in blocks of a bounded number of words; with
more than one block, each block's hits are merged by document. All blocks are on
the driver and in each task at once: the whole benchmark has to fit there.

Defined results: null or empty texts have no words and no hits; items without
words are no windows; rows that repeat an item_id are one item with the windows of
all; repeated documents each have their row; a null item_id is listed as an empty
string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, map_rows, named, steps, with_text

WINDOW = 13
#: Words of the benchmark that one broadcast holds.
BLOCK_WORDS = 2_000_000
#: Contaminated: at least one of this many words is hit.
ONE_IN = 20
#: Bytes of training text of one shard, about.
SHARD_CHARS = 8 << 20

#: ASCII letters and digits (A-Z lowered) and all bytes beyond ASCII make words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def item_words(text: str | None) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split() if text else []


@dataclass
class Block:
    """Benchmark items as word numbers from 1; 0 is any other word."""
    ids: list
    words: dict[bytes, int]
    items: list[np.ndarray]
    window: int

    @classmethod
    def of(cls, rows: list[tuple], window: int) -> Block:
        words: dict[bytes, int] = {}
        ids, items = [], []
        for item_id, text in rows:
            own = item_words(text)
            if own:
                ids.append(item_id)
                items.append(np.array([words.setdefault(w, len(words) + 1) for w in own], np.int32))
        return cls(ids, words, items, window)

    @property
    def shortest(self) -> int:
        return min((min(len(i), self.window) for i in self.items), default=1)


class Shard:
    """Suffix array over documents' word numbers. ``text`` has a 0 behind every
    document and 0 for words that the benchmark lacks; no match crosses a 0."""

    def __init__(self, text: np.ndarray, shortest: int, depth: int) -> None:
        self.text, self.depth = np.append(text, np.zeros(depth + 1, np.int32)), depth
        stop = np.flatnonzero(self.text == 0)
        run = stop[np.searchsorted(stop, np.arange(len(text)))] - np.arange(len(text))
        self.run = run
        self.suffixes = np.flatnonzero(run >= max(1, shortest))
        if len(self.suffixes):
            self._sort()

    def _sort(self) -> None:
        """Prefix doubling: ranks by the first h words give those by 2h. Ranks of
        all positions are needed, so positions within a run keep theirs too."""
        inside = np.flatnonzero(self.run > 0)
        rank = np.zeros(len(self.text), np.int64)
        rank[inside] = self.text[inside]
        h = 1
        while h < self.depth:
            key = rank[inside] * (rank.max() + 1) + rank[np.minimum(inside + h, len(self.text) - 1)] * (self.run[inside] > h)
            _, dense = np.unique(key, return_inverse=True)
            rank[inside] = dense + 1
            if dense.max() + 1 == len(inside):
                break
            h *= 2
        self.suffixes = self.suffixes[np.lexsort((self.suffixes, rank[self.suffixes]))]

    def bounds(self, queries: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query (a row of word numbers, of which ``lengths`` count) the
        stretch of the suffix array that begins with it."""
        n = len(self.suffixes)
        out = []
        for right in (False, True):
            lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), n, np.int64)
            while (open_ := lo < hi).any():
                mid = (lo + hi) >> 1
                at = self.suffixes[np.minimum(mid, n - 1)]
                less = self._less(at, queries, lengths, right)
                lo = np.where(open_ & less, mid + 1, lo)
                hi = np.where(open_ & ~less, mid, hi)
            out.append(lo)
        return out[0], out[1]

    def _less(self, at: np.ndarray, queries: np.ndarray, lengths: np.ndarray, or_equal: bool) -> np.ndarray:
        """Whether the suffix, cut to the query's length, sorts before it."""
        less = np.zeros(len(at), bool)
        open_ = np.ones(len(at), bool)
        for k in range(int(lengths.max())):
            open_ &= lengths > k
            if not open_.any():
                break
            have, want = self.text[at + k], queries[:, k]
            less |= open_ & (have < want)
            open_ &= have == want
        return less | (or_equal & (open_ | self._same(at, queries, lengths)))

    def _same(self, at: np.ndarray, queries: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        span = np.arange(queries.shape[1])
        return ((self.text[np.minimum(at[:, None] + span, len(self.text) - 1)] == queries) | (span >= lengths[:, None])).all(1)

    def longest(self, queries: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest match of each query and one place of it: it is next to where the
        query would be inserted."""
        at, _ = self.bounds(queries, lengths)
        best, place = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        span = np.arange(queries.shape[1])
        for side in (at - 1, at):
            ok = (side >= 0) & (side < len(self.suffixes))
            pos = self.suffixes[np.clip(side, 0, len(self.suffixes) - 1)]
            same = (self.text[np.minimum(pos[:, None] + span, len(self.text) - 1)] == queries) & (span < lengths[:, None])
            n = np.where(ok, np.cumprod(same, axis=1).sum(1), 0)
            place = np.where(n > best, pos, place)
            best = np.maximum(best, n)
        return best, place


@dataclass
class Hits:
    n_words: np.ndarray
    runs: list[list[tuple[int, int]]]
    items: list[list[int]]
    #: (document, item, longest match in words, word position in the document, in the item)
    matches: list[tuple[int, int, int, int, int]]


class Searcher:
    """All suffixes of a benchmark block, ready to be searched in shards."""

    def __init__(self, block: Block) -> None:
        self.block = block
        self.depth = max((len(i) for i in block.items), default=1)
        self.owner = np.concatenate([np.full(len(i), k) for k, i in enumerate(block.items)]) if block.items else np.zeros(0, int)
        self.offset = np.concatenate([np.arange(len(i)) for i in block.items]) if block.items else np.zeros(0, int)
        sizes = np.array([len(i) for i in block.items], int)
        self.length = sizes[self.owner] - self.offset if len(sizes) else np.zeros(0, int)
        #: A suffix as long as its item's window stands for the window at its start.
        self.need = np.minimum(sizes, block.window)[self.owner] if len(sizes) else np.zeros(0, int)

    def rows(self, which: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((len(which), width), np.int32)
        for r, s in enumerate(which):
            part = self.block.items[self.owner[s]][self.offset[s]: self.offset[s] + width]
            out[r, : len(part)] = part
        return out

    def search(self, texts: list[str | None]) -> Hits:
        number = self.block.words.get
        docs = [item_words(t) for t in texts]
        n_words = np.array([len(d) for d in docs], np.int64)
        hits = Hits(n_words, [[] for _ in docs], [[] for _ in docs], [])
        if not self.block.items or not n_words.sum():
            return hits
        text = np.concatenate([np.array([*[number(w, 0) for w in d], 0], np.int32) for d in docs])
        starts = np.concatenate([[0], np.cumsum(n_words + 1)])
        shard = Shard(text, self.block.shortest, self.depth)
        if not len(shard.suffixes):
            return hits
        # suffixes of the benchmark that can match for a window: those whose first words some training suffix has
        firsts = np.unique(shard.text[shard.suffixes])
        first = np.array([self.block.items[k][o] for k, o in zip(self.owner, self.offset)], np.int32)
        live = np.flatnonzero((self.length >= self.need) & np.isin(first, firsts))
        chunk = max(1, (64 << 20) // (8 * self.depth))
        delta = np.zeros(len(text) + 1, np.int64)
        seen: set[tuple[int, int]] = set()
        longest: dict[tuple[int, int], tuple[int, int, int]] = {}
        for at in range(0, len(live), chunk):
            some = live[at: at + chunk]
            lo, hi = shard.bounds(self.rows(some, int(self.need[some].max())), self.need[some])
            found = np.flatnonzero(hi > lo)
            if not len(found):
                continue
            best, place = shard.longest(self.rows(some[found], self.depth), self.length[some[found]])
            for s, a, b, n, p in zip(some[found].tolist(), lo[found].tolist(), hi[found].tolist(), best.tolist(), place.tolist()):
                where = shard.suffixes[a:b]
                np.add.at(delta, where, 1)
                np.add.at(delta, where + int(self.need[s]), -1)
                item = int(self.owner[s])
                for doc in np.unique(np.searchsorted(starts, where, "right") - 1).tolist():
                    seen.add((doc, item))
                doc = int(np.searchsorted(starts, p, "right")) - 1
                if n > longest.get((doc, item), (0,))[0]:
                    longest[doc, item] = (n, p - int(starts[doc]), int(self.offset[s]))
        covered = np.diff(np.concatenate([[0], (np.cumsum(delta)[: len(text)] > 0).astype(np.int8), [0]]))
        begins, ends = np.flatnonzero(covered == 1), np.flatnonzero(covered == -1)
        for doc, b, e in zip((np.searchsorted(starts, begins, "right") - 1).tolist(), begins.tolist(), ends.tolist()):
            hits.runs[doc].append((b - int(starts[doc]), e - int(starts[doc])))
        for doc, item in sorted(seen):
            hits.items[doc].append(item)
        hits.matches = [(d, i, *v) for (d, i), v in sorted(longest.items())]
        return hits


def benchmark_blocks(benchmark: DataFrame, window: int, id_column: str = "item_id", block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The benchmark in blocks of about ``block_words`` words; callers
    hold them all. Its size is looked at first; a usual benchmark is one block."""
    rows = benchmark.select(F.col(id_column).alias("id"), "text")
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // (4 * block_words)))
    for k in range(n):
        some = rows if n == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield Block.of([tuple(r) for r in some.collect()], window)


def _digest(ids: set) -> str:
    return hashlib.sha256(",".join(sorted("" if i is None else str(i) for i in ids)).encode()).hexdigest()


def benchmark_hits(df: DataFrame, benchmark: DataFrame, window: int = WINDOW, one_in: int = ONE_IN, keep: tuple[str, ...] = ("doc_id",),
                   block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: the ``keep`` columns, n_words, n_hit, n_items, items_sha256
    and contaminated. One pass without an exchange while the benchmark is one
    block."""
    return named(_hits(df, benchmark, window, one_in, keep, block_words), keep)


def _hits(df: DataFrame, benchmark: DataFrame, window: int, one_in: int, keep: tuple[str, ...], block_words: int) -> DataFrame:
    blocks = list(benchmark_blocks(benchmark, window, block_words=block_words))
    result = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    shared = [df.sparkSession.sparkContext.broadcast(b) for b in blocks]

    def run(batches: Iterator[pa.RecordBatch]):
        forget()
        searchers = [Searcher(b.value) for b in shared]
        for b in batches:
            for part in steps(b, len(keep), SHARD_CHARS):
                texts = part.column(len(keep)).to_pylist()
                all_hits = [s.search(texts) for s in searchers]
                rows = []
                for d in range(len(texts)):
                    covered: set[int] = set()
                    runs = [r for h in all_hits for r in h.runs[d]]
                    if len(all_hits) == 1:
                        n_hit = sum(e - a for a, e in runs)
                    else:
                        covered.update(*(range(a, e) for a, e in runs))
                        n_hit = len(covered)
                    items = {s.block.ids[i] for s, h in zip(searchers, all_hits) for i in h.items[d]}
                    n = int(all_hits[0].n_words[d])
                    rows.append((n, n_hit, len(items), _digest(items), n_hit > 0 and one_in * n_hit >= n))
                columns = list(zip(*rows)) or [()] * 5
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(len(keep))], *[pa.array(c, t) for c, t in zip(columns, types)]],
                                                 [*part.schema.names[: len(keep)], "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return with_text(df, keep, "text", result, run)


def longest_matches(df: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Longest verbatim matches with their places: doc_id, item_id (as text),
    words, doc_word, item_word; the longest of a shard for each document and item
    that it is found in, at least a window."""
    shared = [df.sparkSession.sparkContext.broadcast(b) for b in benchmark_blocks(benchmark, window)]

    def run(batches: Iterator[pa.RecordBatch]):
        forget()
        searchers = [Searcher(b.value) for b in shared]
        for b in batches:
            for part in steps(b, 1, SHARD_CHARS):
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                rows = [(ids[d], None if s.block.ids[i] is None else str(s.block.ids[i]), n, p, o) for s in searchers for d, i, n, p, o in s.search(texts).matches]
                columns = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()))],
                                                 ["doc_id", "item_id", "words", "doc_word", "item_word"])

    return map_rows(df.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id", "text"], "doc_id long, item_id string, words long, doc_word long, item_word long", run)


def decontaminated(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that are not contaminated, with all their columns."""
    keep = tuple(df.columns)
    return named(_hits(df, benchmark, WINDOW, ONE_IN, keep, BLOCK_WORDS).where(~F.col("contaminated")), keep, results=False)
