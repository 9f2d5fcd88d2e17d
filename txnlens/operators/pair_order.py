"""Order statistics of products that are never stored: cosines of all row pairs, and
of all rows with a bounded block of reference rows.

Values exist only inside a task, as the result of a matrix product. The first pass
counts them on a ``Grid`` of equal cells, an addition a value. Then only the values of
cells that matter are looked at: they go into bins (count, least and greatest value of
each bin that has any); the driver holds the bins, at most ``MOST_BINS`` a value set
beside the cells, splits those that matter and sends the new edges out. A bin whose least
and greatest value agree is one value with its exact count. So

* a quantile narrows the bins that hold its two order statistics until they are known:
  bins with one value, or positions at a bin's ends;
* ranks come from the bins: all values of a bin share their mid-rank. Bins are split
  until each is one value (at most ``EXACT`` values: Spearman's coefficient is exact,
  ties included) or holds at most the ``RESOLUTION``-th part of all (then a rank is
  off by less than half of that part of n). Cells that hold more are first split on the
  grid, where a rank is a look-up; ties are left to the bins. The products of ranks are
  summed in the pass that narrows the quantiles, if ranks are known by then.

Cosines are rounded to ``DIGITS`` decimals, so that equal ones are ties whatever the
order in which a product was added up; tasks hold them as whole numbers of that unit.

Pairs i < j: rows are packed into blocks, blocks dealt into parts, and every two parts
are a group and a task, written once to the shared checkpoint. A task makes the products
of its blocks, a tile at a time, and counts all of them before it sends its bins on.
The number of parts follows the cores, so what is written grows with the rows, and the
bins sent in a pass have the same bound for any number of rows; beyond PART_BLOCKS
blocks a part there are more parts, so that a task's memory is bounded too.

Rows beside reference rows: one product an Arrow batch. Rows without a vector, and
vectors of another length than the most common one, take no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.functions import vectors as V
from txnlens.session import cut_lineage

DIGITS = 12
UNIT = 10.0 ** DIGITS
#: Rows of a block; a meeting of two is a product of at most so many squared values.
BLOCK_ROWS = 1024
#: Bins at most, bins that travel together.
MOST_BINS, CHUNK = 1 << 20, 1 << 16
#: Units of a cell of the grid and of the half of it below 0, as powers of 2; part of all values that a cell's part should hold, of RESOLUTION's.
CELL_BITS, HALF_BITS, FINER = 21, 40, 4
#: Values of a product that are made and counted at once: what fits a core's cache.
TILE = 1 << 16
#: Values that small counts hold whatever bins they are in.
MOST_COUNT, _ONE = (1 << 32) - 1, np.uint32(1)
#: Up to so many values every distinct one gets its own bin; beyond, a bin holds at most this part of all.
EXACT, RESOLUTION = 1 << 19, 1 << 16
#: Values that are sorted and counted at once, about.
AT_ONCE = 4 << 20
#: Groups of blocks for every core of the cluster, about; blocks of a part at most; bytes of an Arrow batch of blocks.
GROUPS_A_CORE, PART_BLOCKS, BATCH_BYTES, _BATCH_KEY = 2, 256, 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
_CELL = np.dtype([("bin", "<i4"), ("count", "<i8"), ("low", "<f8"), ("high", "<f8")])
#: Of a value set: chunk -1 is its sums, from 0 on cells, from -2 down counts of a grid.
_ROWS = "name string, chunk int, cells binary"
_NOTHING = {"name": "", "chunk": -1, "cells": b""}  # a frame without rows has no types
_RANKS = "products of ranks"
Edges = dict[str, np.ndarray]


class Grid:
    """Bins of whole numbers in reach of a cosine: cells of ``2 ** CELL_BITS``, and in
    some of them ``2 ** (CELL_BITS - shift)`` equal parts, numbered in order."""

    def __init__(self, shift: np.ndarray | None = None) -> None:
        cells = 1 << (HALF_BITS + 1 - CELL_BITS)
        self.shift = shift
        self.base = None if shift is None else np.cumsum(parts := 1 << (CELL_BITS - shift.astype(np.int64))) - parts
        self.n = cells if shift is None else int(parts.sum())
        self._at = self._bin = None

    def of(self, values: np.ndarray) -> np.ndarray:
        """The bin of each value; the next call writes to the same array."""
        if self._at is None or len(self._at) < len(values):
            self._at, self._bin = np.empty(len(values)), np.empty(len(values), np.int64)
        at, out = self._at[: len(values)], self._bin[: len(values)]
        np.add(values, float(1 << HALF_BITS), out=at)
        if np.isnan(at.sum()):
            at[np.isnan(at)] = (2 << HALF_BITS) - 1  # above all others, as when sorted
        if self.base is not None:
            rest = at.astype(np.int64) & ((1 << CELL_BITS) - 1)
        np.copyto(out, np.multiply(at, 0.5 ** CELL_BITS, out=at), casting="unsafe")
        return out if self.base is None else self.base[out] + (rest >> self.shift[out])

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest number that each bin can hold."""
        if self.base is None:
            low, width = (np.arange(self.n) << CELL_BITS) - (1 << HALF_BITS), 1 << CELL_BITS
        else:
            shift = self.shift.astype(np.int64)
            cell = np.repeat(np.arange(len(shift)), 1 << (CELL_BITS - shift))
            width = 1 << shift[cell]
            low = (cell << CELL_BITS) + (np.arange(self.n) - self.base[cell]) * width - (1 << HALF_BITS)
        return low, low + width - 1

    def bins(self, count: np.ndarray, sums: np.ndarray) -> Bins:
        low, high = self.ends()
        own = np.flatnonzero(count[: self.n])
        cells = np.empty(len(own), _CELL)
        cells["bin"], cells["count"], cells["low"], cells["high"] = own, count[own], low[own] / UNIT, high[own] / UNIT
        return Bins(cells, *sums.tolist(), seen=np.zeros(len(own), bool))

    def finer(self, own: Bins) -> Grid:
        """Cells that hold too many values for their ranks, in as many parts as would do
        if they were spread evenly, times FINER; together about 2 * FINER * RESOLUTION."""
        shift = np.full(self.n, CELL_BITS)
        parts = FINER * own.count[own.rough] / max(own.n // RESOLUTION, 1)
        shift[own.bin[own.rough]] -= np.minimum(np.ceil(np.log2(parts)).astype(np.int64), CELL_BITS)
        return Grid(shift.astype(np.int8))


class Bins:
    """Counted bins of one value set, those without values left out. ``seen``: their least
    and greatest values are known; ``low`` and ``high`` are bounds of the other ones."""

    def __init__(self, cells: np.ndarray, total: float = 0.0, squares: float = 0.0, seen: np.ndarray | None = None) -> None:
        if seen is None:
            cells, seen = by_bin(cells), np.ones(len(cells), bool)
        self.bin, self.count, self.low, self.high = (cells[c].copy() for c in ("bin", "count", "low", "high"))
        self.seen, self.n = seen, int(self.count.sum())
        self.before = np.cumsum(self.count) - self.count
        self.total, self.squares = total, squares
        self.cells, self.ranked = cells, self

    @property
    def open(self) -> np.ndarray:
        """Bins of more than one distinct value, as far as is known."""
        return self.low < self.high

    @property
    def rough(self) -> np.ndarray:
        """Bins that hold too many values for their ranks."""
        return self.open & (self.count > (1 if self.n <= EXACT else self.n // RESOLUTION))

    def at(self, position: int) -> tuple[int, float | None]:
        """The bin of a 0-based position and its value, None if not known yet."""
        k = int(np.searchsorted(self.before, position, "right")) - 1
        if not self.open[k] or self.seen[k] and position == self.before[k]:
            return k, float(self.low[k])
        return k, float(self.high[k]) if self.seen[k] and position == self.before[k] + self.count[k] - 1 else None

    def quantile(self, q: float) -> float | None:
        """Linear interpolation at q * (n - 1); None if a neighbour is not known yet."""
        if not self.n:
            return None
        x = q * (self.n - 1)
        lo, hi = (self.at(p)[1] for p in (math.floor(x), math.ceil(x)))
        return None if lo is None or hi is None else lo + (x - math.floor(x)) * (hi - lo)

    def wanted(self, quantiles: list[float], ranks: bool) -> np.ndarray:
        """Bins that have to be split."""
        split = self.rough if ranks else np.zeros(len(self.count), bool)
        for q in quantiles:
            x = q * (self.n - 1)
            for p in (math.floor(x), math.ceil(x)) if self.n else ():
                k, known = self.at(p)
                split[k] |= known is None
        return split

    def edges(self, split: np.ndarray) -> np.ndarray:
        """Lower edges of the bins of the next pass: those of the seen bins, and equal
        steps inside the ones to split, more where there are more values. The greatest
        value of a bin has an edge of its own, so every pass makes progress."""
        count, low, high = self.count[split], np.rint(self.low[split] * UNIT).astype(np.int64), np.rint(self.high[split] * UNIT).astype(np.int64)
        room = max(MOST_BINS - int(self.seen.sum()), 0)
        steps = np.minimum(np.maximum((count * (room / max(count.sum(), 1))).astype(np.int64), 2), high - low)
        start = np.cumsum(steps + 1) - (steps + 1)
        k = np.arange(int((steps + 1).sum())) - np.repeat(start, steps + 1)
        inner = np.repeat(low, steps + 1) + k * np.repeat(high - low, steps + 1) // np.repeat(steps, steps + 1)
        return np.unique(np.concatenate([self.low[self.seen], inner / UNIT]))

    def without(self, split: np.ndarray) -> Bins:
        return Bins(self.cells[~split], self.total, self.squares, self.seen[~split])

    def joined(self, other: Bins) -> Bins:
        """These bins and those that were seen in the place of the ones left out."""
        cells, seen = np.concatenate([self.cells, other.cells]), np.concatenate([self.seen, other.seen])
        order = np.argsort(cells["low"], kind="stable")
        return Bins(cells[order], self.total, self.squares, seen[order])

    def mid_ranks(self) -> np.ndarray:
        """Mid-ranks about their mean, as a part of n."""
        return (self.before + (self.count - 1) / 2 - (self.n - 1) / 2) / max(self.n, 1)

    @property
    def resolution(self) -> float:
        """The part of all values that the greatest bin without exact ranks holds."""
        vague = self.open & (self.count > 1)
        return float(self.count[vague].max() / self.n) if vague.any() else 0.0


def counted(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Cells of the bins that hold any of the ``values``. Below the first edge counts
    to the first bin."""
    own = Tally(edges)
    own.add(values)
    return own.cells()


class Tally:
    """Running counts, least and greatest values of all bins of ``edges``."""

    def __init__(self, edges: np.ndarray) -> None:
        self.edges = edges
        self.count = np.zeros(len(edges), np.int64)
        self.low, self.high = np.full(len(edges), np.inf), np.full(len(edges), -np.inf)
        self.sums = np.zeros(2)
        self.held: list[np.ndarray] = []

    def add(self, values: np.ndarray) -> None:
        values = values.ravel()
        self.held.append(values)
        self.sums += [values.sum(), values @ values]
        if sum(v.size for v in self.held) >= AT_ONCE:
            self.count_held()

    def count_held(self) -> None:
        """One search for all edges among the values of several products."""
        values = np.sort(np.concatenate([*self.held, np.empty(0)]))
        self.held = []
        cut = np.searchsorted(values, self.edges[1:], "left")
        start, stop = np.concatenate([[0], cut]), np.concatenate([cut, [len(values)]])
        own = np.flatnonzero(stop > start)
        start, stop = start[own], stop[own]
        self.count[own] += stop - start
        self.low[own] = np.minimum(self.low[own], values[start])
        self.high[own] = np.maximum(self.high[own], values[stop - 1])

    def cells(self) -> np.ndarray:
        self.count_held()
        own = np.flatnonzero(self.count)
        cells = np.empty(len(own), _CELL)
        cells["bin"], cells["count"], cells["low"], cells["high"] = own, self.count[own], self.low[own], self.high[own]
        return cells


def by_bin(cells: np.ndarray) -> np.ndarray:
    return cells[np.argsort(cells["bin"], kind="stable")]  # runs in order: a merge, many times faster than sorting records


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    cells = by_bin(np.concatenate([a, b]))
    first = np.flatnonzero(np.diff(cells["bin"], prepend=-1))
    out = cells[first].copy()
    if len(cells):
        out["count"] = np.add.reduceat(cells["count"], first)
        out["low"], out["high"] = np.minimum.reduceat(cells["low"], first), np.maximum.reduceat(cells["high"], first)
    return out


class CellCounter:
    """Counts the products of one task into the bins of ``edges``."""

    def __init__(self, edges: Edges) -> None:
        self.edges, self.tallies = edges, {}

    def add(self, values: dict[str, np.ndarray]) -> None:
        for name, v in values.items():
            if name not in self.edges or not v.size:
                continue
            if name not in self.tallies:
                self.tallies[name] = Tally(self.edges[name])
            self.tallies[name].add(v / UNIT)

    def rows(self) -> Iterator[dict]:
        if not self.tallies:
            yield dict(_NOTHING)
        for name, tally in self.tallies.items():
            yield {"name": name, "chunk": -1, "cells": tally.sums.tobytes()}
            cells = tally.cells()
            at = np.searchsorted(cells["bin"], np.arange(0, len(tally.edges) + CHUNK, CHUNK))
            for k, (lo, hi) in enumerate(zip(at, at[1:])):
                if hi > lo:
                    yield {"name": name, "chunk": k, "cells": cells[lo:hi].tobytes()}


def packed(count: np.ndarray) -> bytes:
    """CHUNK counts in the smallest type that holds them."""
    return count.astype(np.min_scalar_type(int(count.max()))).tobytes()


def unpacked(cells: bytes) -> np.ndarray:
    return np.frombuffer(cells, f"u{len(cells) // CHUNK}").astype(np.int64)


class GridCounter:
    """Counts the products of one task on grids."""

    def __init__(self, grids: dict[str, Grid]) -> None:
        self.grids, self.sums = grids, {}
        self.counts: dict[str, np.ndarray] = {}
        self.small: dict[str, np.ndarray] = {}  # half the size stays in the processor's cache
        self.room: dict[str, int] = {}

    def add(self, values: dict[str, np.ndarray]) -> None:
        for name, v in values.items():
            if name not in self.grids or not v.size:
                continue
            grid = self.grids[name]
            if name not in self.counts:
                n = -(-grid.n // CHUNK) * CHUNK
                self.counts[name], self.small[name], self.sums[name], self.room[name] = np.zeros(n, np.int64), np.zeros(n, np.uint32), np.zeros(2), MOST_COUNT
            if v.size > self.room[name]:
                self.widen(name)
            np.add.at(self.small[name], grid.of(v), _ONE)
            self.room[name] -= v.size
            self.sums[name] += [v.sum(), v @ v]

    def widen(self, name: str) -> None:
        self.counts[name] += self.small[name]
        self.small[name][:] = 0
        self.room[name] = MOST_COUNT

    def rows(self) -> Iterator[dict]:
        if not self.counts:
            yield dict(_NOTHING)
        for name, count in self.counts.items():
            self.widen(name)
            yield {"name": name, "chunk": -1, "cells": (self.sums[name] / [UNIT, UNIT * UNIT]).tobytes()}
            for k, own in enumerate(count.reshape(-1, CHUNK)):
                if own.any():
                    yield {"name": name, "chunk": -2 - k, "cells": packed(own)}


class Within:
    """Passes on the values of some bins of a grid, by name: grid, which bins."""

    def __init__(self, some: dict[str, tuple[Grid, np.ndarray]], sink) -> None:
        self.some, self.sink = some, sink

    def add(self, values: dict[str, np.ndarray]) -> None:
        self.sink.add({name: v[np.flatnonzero(which.take(grid.of(v), mode="clip"))] for name, v in values.items() if name in self.some for grid, which in [self.some[name]]})

    def rows(self) -> Iterator[dict]:
        return self.sink.rows()


class Ranks:
    """Mid-ranks of a set's values: a look-up by the bins of ``grid``, a search in those
    that are, or are to be, split further, the ``inside`` ones."""

    def __init__(self, grid: Grid, inside: np.ndarray, own: Bins) -> None:
        ranks, there = own.mid_ranks(), own.seen.copy()
        there[~own.seen] = inside[own.bin[~own.seen]]
        self.grid, self.table = grid, np.zeros(grid.n)
        self.table[inside] = np.nan
        self.table[own.bin[~there]] = ranks[~there]
        self.low, self.ranks = own.low[there], ranks[there]

    def of(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks, and where the values of the ``inside`` bins are."""
        out = self.table.take(self.grid.of(values), mode="clip")
        at = np.flatnonzero(np.isnan(out))
        some = values[at] / UNIT
        order = np.argsort(some)  # a search in order stays in the processor's cache
        out[at[order]] = self.ranks[np.maximum(np.searchsorted(self.low, some[order], "right") - 1, 0)] if len(at) else 0.0
        return out, at


class RankProducts:
    """Adds up the products of two sets' mid-ranks, pair by pair. ``ranks``: those of
    either set by name; ``sink`` gets the values of their ``inside`` bins."""

    def __init__(self, ranks: dict[str, Ranks], sink=None) -> None:
        self.ranks, self.sink, self.total = ranks, sink, 0.0

    def add(self, values: dict[str, np.ndarray]) -> None:
        (x, at_x), (y, at_y) = (own.of(values[name]) for name, own in self.ranks.items())
        self.total += float(x @ y)
        if self.sink:
            self.sink.add({name: values[name][at] for name, at in zip(self.ranks, (at_x, at_y))})

    def rows(self) -> Iterator[dict]:
        yield {"name": _RANKS, "chunk": -1, "cells": np.array([self.total]).tobytes()}
        if self.sink:
            yield from self.sink.rows()


def _added(batches):
    """Cells or counts of each (name, chunk) of the partition, added where they meet."""
    import pandas as pd
    sums: dict = {}
    for pdf in batches:
        for name, chunk, cells in zip(pdf["name"], pdf["chunk"], pdf["cells"]):
            key = (name, int(chunk))
            own = unpacked(cells) if chunk < -1 else np.frombuffer(cells, np.float64 if chunk < 0 else _CELL)
            sums[key] = own if key not in sums else sums[key] + own if chunk < 0 else merged(sums[key], own)
    if sums:
        yield pd.DataFrame({"name": [k[0] for k in sums], "chunk": [k[1] for k in sums], "cells": [packed(v) if k[1] < -1 else v.tobytes() for k, v in sums.items()]})


class Products:
    """Value sets that tasks make anew in every pass. ``each(sink, schema)`` feeds all
    products of a task to a ``sink()`` and gives the rows of all sinks."""

    def __init__(self, df: DataFrame, names: list[str], each: Callable[[Callable, str], DataFrame]) -> None:
        self.names, self._each, self._context = names, each, df.sparkSession.sparkContext

    def summed(self, make: Callable, shared) -> dict[tuple[str, int], bytes]:
        """What the sinks ``make(shared)`` of all tasks send on, by name and chunk."""
        sent = self._context.broadcast(shared)
        rows = self._each(lambda: make(sent.value), _ROWS).repartition("name", "chunk").mapInPandas(_added, _ROWS).collect()  # at most MOST_BINS a set, or a grid's counts
        sent.unpersist()
        return {(r["name"], r["chunk"]): r["cells"] for r in rows}

    def on(self, grids: dict[str, Grid]) -> dict[str, Bins]:
        """The values of each set counted on its grid."""
        rows, out = self.summed(GridCounter, grids), {}
        for name, grid in grids.items():
            count = np.zeros(-(-grid.n // CHUNK) * CHUNK, np.int64)
            for k, own in enumerate(count.reshape(-1, CHUNK)):
                if (name, -2 - k) in rows:
                    own += unpacked(rows[name, -2 - k])
            out[name] = grid.bins(count, np.frombuffer(rows.get((name, -1), bytes(16))))
        return out

    def ordered(self, quantiles: list[float], ranks: bool = False) -> dict[str, Bins]:
        """Bins in which every quantile is known and, with ``ranks``, ranks are."""
        self._grids = {n: Grid() for n in self.names}
        done = self.on(self._grids)
        if ranks:
            finer = {n: self._grids[n].finer(own) for n, own in done.items() if own.n > EXACT and own.rough.any()}
            if finer:
                self._grids |= finer
                done |= self.on(finer)
        self._inside, rest = {}, {}
        for name, own in done.items():
            split = own.wanted(quantiles, ranks)
            self._inside[name] = np.zeros(self._grids[name].n, bool)
            self._inside[name][own.bin[split]] = True
            rest[name] = own.without(split)
        self._total: float | None = None
        while todo := {n: split for n, own in done.items() if (split := own.wanted(quantiles, ranks)).any()}:
            # ranks that are known need no pass of their own
            now = ranks and len(done) == 2 and self._total is None and not any(own.rough.any() for own in done.values())
            edges = {n: done[n].edges(split) for n, split in todo.items()}
            if now:
                rows = self.summed(lambda x: RankProducts(x[0], CellCounter(x[1])), (self._ranks(done), edges))
            else:
                rows = self.summed(lambda x: Within(x[0], CellCounter(x[1])), ({n: (self._grids[n], self._inside[n]) for n in todo}, edges))
            if now:
                self._total = float(np.frombuffer(rows[_RANKS, -1])[0])
            for name in todo:
                cells = [np.frombuffer(c, _CELL) for (n, k), c in rows.items() if n == name and k >= 0]
                own = rest[name].joined(Bins(np.concatenate(cells)))
                own.ranked = own if self._total is None else done[name].ranked
                done[name] = own
        return done

    def _ranks(self, sets: dict[str, Bins]) -> dict[str, Ranks]:
        return {n: Ranks(self._grids[n], self._inside[n], own) for n, own in sets.items()}

    def rank_correlation(self, a: Bins, b: Bins) -> float | None:
        """Pearson's coefficient of the mid-ranks of both value sets, pair by pair; of
        the bins that ``ordered`` gave last."""
        a, b = a.ranked, b.ranked
        spread = [float((x.count * x.mid_ranks() ** 2).sum()) for x in (a, b)]
        if min(spread) <= 0:
            return None
        if self._total is None:
            rows = self.summed(RankProducts, self._ranks(dict(zip(self.names, (a, b)))))
            self._total = float(np.frombuffer(rows[_RANKS, -1])[0])
        return self._total / math.sqrt(spread[0] * spread[1])


def _frame(sink, schema: str):
    import pandas as pd
    return pd.DataFrame(list(sink.rows()), columns=[f.split()[0] for f in schema.split(", ")])


def _whole(products: np.ndarray) -> np.ndarray:
    """Rounded to DIGITS decimals, in units of the last one; in place."""
    return np.rint(np.multiply(products, UNIT, out=products), out=products)


def meeting(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
    """The products of two blocks' rows, a tile at a time, which the next one overwrites;
    of a block with itself those above the diagonal."""
    rows, cols = (len(next(iter(x.values()))) for x in (a, b))
    step = max(TILE // max(cols, 1), 1)
    own = {c: np.empty(min(step, rows) * cols) for c in a}
    for at in range(0, rows, step):
        n, first = min(step, rows - at), at if a is b else 0
        tiles = {c: _whole(np.matmul(v[at: at + n], b[c][first:].T, out=own[c][: n * (cols - first)].reshape(n, -1))) for c, v in a.items()}
        upper = np.triu_indices(n, 1, cols - first) if a is b else None
        yield {c: m[upper] if upper else m.ravel() for c, m in tiles.items()}


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / (np.linalg.norm(rows, axis=1, keepdims=True) + V.GEOMETRY_EPS)


def with_vectors(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose vectors are there, whole and of the commonest length."""
    for c in columns:
        df = df.where(F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull()))
    common = df.groupBy(*[F.size(c).alias(f"_{c}") for c in columns]).count().orderBy(F.desc("count"), *[f"_{c}" for c in columns]).first()
    return df.where(" AND ".join(f"size(`{c}`) = {common[f'_{c}']}" for c in columns)) if common else df


def pair_cosines(df: DataFrame, key: str, vectors: dict[str, str]) -> Products:
    """The cosines of all pairs i < j of rows, for every named vector column."""
    import pandas as pd
    df = with_vectors(df.select(key, *dict.fromkeys(vectors.values())), list(dict.fromkeys(vectors.values())))
    n = max(-(-df.count() // BLOCK_ROWS), 1)
    names, spark = list(vectors), df.sparkSession

    def pack(pdf):
        pdf = pdf.sort_values("_k", kind="stable")
        return pd.DataFrame({"block": pdf["_b"].iloc[:1], "n": [len(pdf)], **{c: [_unit(np.stack(pdf[c].to_numpy()).astype(np.float64)).tobytes()] for c in names}})

    cells = ", ".join(f"{c} binary" for c in names)
    rows = df.select(F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("_b"), F.col(key).alias("_k"), *[V.as_double(v).alias(c) for c, v in vectors.items()])
    blocks = rows.groupBy("_b").applyInPandas(pack, f"block int, n int, {cells}")
    # every two parts are a group: as many groups for any number of rows, until a part is PART_BLOCKS
    parts = max(min(n, math.ceil(math.sqrt(2 * GROUPS_A_CORE * spark.sparkContext.defaultParallelism))), -(-n // PART_BLOCKS))
    own, other = F.pmod("block", F.lit(parts)), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("other")
    copies = blocks.select("block", "n", *names, own.cast("int").alias("own"), other)
    least, most = F.least("own", "other"), F.greatest("own", "other")
    # of a group (i, i) part i is both sides
    grouped = copies.select((least * parts + most).alias("group"), (F.col("own") != least).cast("int").alias("side"), (least == most).alias("same"), "block", "n", *names)
    limit = spark.conf.get(_BATCH_KEY, None)
    if limit is None or not limit.isdigit() or not 0 < int(limit) <= BATCH_BYTES:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))  # by rows alone, 10,000 blocks would be one batch
    # a task each, those of one part last as they are half the work; dealt out and sorted once, every pass reads this without an exchange
    i, j = F.floor(F.col("group") / parts).cast("int"), F.pmod("group", F.lit(parts))
    task = F.when(F.col("same"), parts * (parts - 1) // 2 + i).otherwise((i * (2 * parts - i - 1) / 2).cast("int") + j - i - 1)
    meetings = cut_lineage(grouped.repartitionById(parts * (parts + 1) // 2, task.cast("int")).sortWithinPartitions("group", "side", "block"))

    def each(sink, schema):
        def meet(batches):
            own, group, held = None, None, []
            for pdf in batches:
                for row in pdf.to_dict("records"):
                    own = own or sink()
                    if row["group"] != group:
                        group, held = row["group"], []
                    b = {c: np.frombuffer(row[c]).reshape(row["n"], -1) for c in names}
                    if row["side"] == 0:
                        held.append(b)
                    for a in held if row["same"] or row["side"] else ():
                        for values in meeting(a, b):
                            own.add(values)
            if own:
                yield _frame(own, schema)

        return meetings.mapInPandas(meet, schema)

    return Products(df, names, each)


def reference_cosines(df: DataFrame, vec: str, reference: np.ndarray, name: str = "cos") -> Products:
    """The cosines of every row with every row of ``reference``, a bounded block."""
    block = df.sparkSession.sparkContext.broadcast(_unit(reference.astype(np.float64)))
    rows = df.where(F.col(vec).isNotNull() & ~F.exists(vec, lambda x: x.isNull()) & (F.size(vec) == reference.shape[1])).select(V.as_double(vec).alias("v"))

    def each(sink, schema):
        def run(batches):
            own = sink()
            for pdf in batches:
                for at in range(0, len(pdf), BLOCK_ROWS):
                    for values in meeting({name: _unit(np.stack(pdf["v"].iloc[at: at + BLOCK_ROWS].to_numpy()))}, {name: block.value}):
                        own.add(values)
            yield _frame(own, schema)

        return rows.mapInPandas(run, schema)

    return Products(df, [name], each)


def reference_rows(df: DataFrame, key: str, vec: str, n: int, seed: int) -> np.ndarray:
    """At most ``n`` rows' vectors, those with the least md5("seed:key"); n bounds what
    reaches the driver."""
    from txnlens.operators.sampling import exact_sample
    rows = exact_sample(with_vectors(df.select(key, vec), [vec]), key, n, seed).orderBy(key).collect()
    return np.array([r[vec] for r in rows], np.float64)


QUANTILES = {"median": 0.5, "p5": 0.05, "p95": 0.95}


def order_block(bins: Bins, prefix: str) -> dict:
    """Mean, std (population) and quantiles of one value set; None without values."""
    mean = bins.total / bins.n if bins.n else None
    std = math.sqrt(max(bins.squares / bins.n - mean * mean, 0.0)) if bins.n else None
    return {f"{prefix}mean": mean, f"{prefix}std": std, **{f"{prefix}{k}": bins.quantile(q) for k, q in QUANTILES.items()}}


def pair_order_report(df: DataFrame, key: str, vin: str, vout: str) -> dict:
    """Mean, std, median, p5 and p95 of the pair cosines of both vector columns, and
    their rank correlation. ``rank_resolution`` is 0 where it is exact."""
    products = pair_cosines(df, key, {"in": vin, "out": vout})
    bins = products.ordered(list(QUANTILES.values()), ranks=True)
    a, b = bins["in"], bins["out"]
    return {"n_pairs": a.n, **order_block(a, "in_"), **order_block(b, "out_"),
            "spearman_r": products.rank_correlation(a, b) if a.n else None, "rank_resolution": max(a.ranked.resolution, b.ranked.resolution)}
