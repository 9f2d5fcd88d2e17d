"""Exact top-k by inner product: a dual-tree search over cover trees.

Rows are placed by their nearest pivot and cut into blocks of a bounded size;
each block of candidates and each block of queries gets a cover tree. Two blocks
meet in one task, unless the bound for all their pairs is below the worst k-th
score that the query block has from the first round (its own pivot's candidates).
In the task, pairs of nodes are searched best bound first: no descendants of
(a, b) score more than <a, b> + |a| r_b + |b| r_a + r_a r_b (centres a, b, covering
radii r), so a pair whose bound is below the worst k-th score in a's group is
pruned; small pairs of nodes are scored by one matrix product.

Equal vectors are one vector with the least k + 1 ids: no other of its ids can be
in any answer. So a vector that very many rows repeat costs no more than another.

Scores are integers and computed exactly (float64 holds them while
dim * max^2 < 2^53). Defined results: vectors null, empty, or holding null or
non-finite components take no part; vectors of another dimension than a query's
are no candidates for it; ties go to the smaller id; null ids take no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import few_by_hash, written

K = 20
SCALE = 64
#: Rows of a block; rows for a pivot, up to so many pivots (a bounded sample of the rows).
BLOCK, PER_PIVOT, PIVOTS = 2048, 4096, 256
LEAF = 96
#: Fills rows of ids.
NO_ID = np.iinfo(np.int64).max


class CoverTree:
    """Nodes over points in tree order: ``first``, ``last`` (its stretch of points),
    ``centre`` (a point), ``radius`` (to its farthest descendant), ``children``."""

    def __init__(self, points: np.ndarray) -> None:
        n = len(points)
        square = (points * points).sum(1)
        dist = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * points @ points.T, 0))
        top = dist[0].max() if n else 0.0
        # a net for each scale: every point within the scale of a centre, centres farther apart than it
        parent_of: list[dict[int, int]] = []
        centres = [0]
        cover, near = dist[0].copy(), np.zeros(n, np.int64)
        scale = top
        while n and scale > 0 and len(centres) < n:
            scale /= 2
            parents = {c: c for c in centres}
            before, before_near = cover.copy(), near.copy()
            for p in np.flatnonzero(before > scale).tolist():
                if cover[p] > scale:
                    parents[p] = int(before_near[p])
                    centres.append(p)
                    closer = dist[p] < cover
                    near[closer] = p
                    cover = np.minimum(cover, dist[p])
            parent_of.append(parents)
            if scale < 0.5:  # points are integers: all are centres by now
                break
        # from the nets to nested nodes; a centre that is alone at a scale needs no node there
        self.order: list[int] = []
        self.centre, self.first, self.last, self.radius, self.children = [], [], [], [], []
        below: list[dict[int, list[int]]] = []
        for parents in parent_of:
            some: dict[int, list[int]] = {}
            for c, p in parents.items():
                some.setdefault(p, []).append(c)
            below.append(some)
        if n:
            self._node(0, 0, below)
        self.points = points[self.order]
        self.norm = np.sqrt((self.points * self.points).sum(1))
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        for k in range(len(self.centre)):
            own = self.order[self.first[k]: self.last[k]]  # a node that was merged away keeps a stretch, unused
            self.radius[k] = float(dist[self.centre[k], own].max())
            self.centre[k] = int(place[self.centre[k]])

    def _node(self, centre: int, level: int, below: list[dict[int, list[int]]]) -> int:
        while level < len(below) and below[level].get(centre, [centre]) == [centre]:
            level += 1
        k = len(self.centre)
        self.centre.append(centre)
        self.first.append(len(self.order))
        self.last.append(0)
        self.radius.append(0.0)
        self.children.append([])
        if level == len(below):
            self.order.append(centre)
        else:
            self.children[k] = self._grouped([self._node(c, level + 1, below) for c in below[level][centre]])
        self.last[k] = len(self.order)
        return k

    def _grouped(self, kids: list[int]) -> list[int]:
        """Neighbouring children that are small together become one node over their
        points (which lie side by side), with its own covering radius: in many
        dimensions a node has very many single points below it."""
        out: list[int] = []
        open_ = False
        for c in kids:
            n = (self.last[c] or len(self.order)) - self.first[c]
            if open_ and n <= LEAF and self.last[c] - self.first[out[-1]] <= LEAF:
                self.last[out[-1]] = self.last[c]
                self.children[out[-1]] = []
            else:
                out.append(c)
            open_ = n <= LEAF
        return out


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), NO_ID)

    @property
    def worst(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, rows: slice, scores: np.ndarray, ids: np.ndarray) -> None:
        """``ids``: a row of ids (least first, then filled) for each candidate."""
        better = scores >= self.worst[rows][:, None]
        hit = np.flatnonzero(better.any(1))
        if not hit.size:
            return
        used = np.flatnonzero(better[hit].any(0))
        which, place = np.nonzero(ids[used] != NO_ID)
        at = rows.start + hit
        score = np.concatenate([self.score[at], scores[np.ix_(hit, used[which])]], 1)
        own = np.concatenate([self.id[at], np.broadcast_to(ids[used][which, place], (len(hit), len(which)))], 1)
        # by id, then stably by falling score
        by_id = np.argsort(own, axis=1, kind="stable")
        score, own = np.take_along_axis(score, by_id, 1), np.take_along_axis(own, by_id, 1)
        order = np.argsort(-score, axis=1, kind="stable")[:, : self.k]
        self.score[at], self.id[at] = np.take_along_axis(score, order, 1), np.take_along_axis(own, order, 1)


def search(queries: CoverTree, tree: CoverTree, ids: np.ndarray, best: Best) -> None:
    """Dual-tree search; query rows of ``best`` are in the query tree's order."""
    def bound(a: int, b: int) -> float:
        x, y = queries.centre[a], tree.centre[b]
        return float(queries.points[x] @ tree.points[y]) + queries.norm[x] * tree.radius[b] + tree.norm[y] * queries.radius[a] + queries.radius[a] * tree.radius[b]

    heap = [(-bound(0, 0), 0, 0)] if len(queries.points) and len(tree.points) else []
    while heap:
        most, a, b = heapq.heappop(heap)
        rows = slice(queries.first[a], queries.last[a])
        if -most + 1e-6 * (1 + abs(most)) < best.worst[rows].min():
            continue
        cols = slice(tree.first[b], tree.last[b])
        small_a, small_b = rows.stop - rows.start <= LEAF or not queries.children[a], cols.stop - cols.start <= LEAF or not tree.children[b]
        if small_a and small_b:
            best.add(rows, queries.points[rows] @ tree.points[cols].T, ids[cols])
            continue
        split_b = not small_b and (small_a or tree.radius[b] >= queries.radius[a])
        for x, y in [(a, c) for c in tree.children[b]] if split_b else [(c, b) for c in queries.children[a]]:
            heapq.heappush(heap, (-bound(x, y), x, y))


def whole_vectors(df: DataFrame, id_column: str, column: str, scale: int) -> DataFrame:
    """id and v: floor(scale * component) as whole numbers; rows without a value in
    some component are left out."""
    x = F.transform(F.col(column), lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    fine = F.col(column).isNotNull() & (F.size(column) > 0) & F.forall(F.col(column), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return df.where(fine & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), x.cast("array<long>").alias("v"))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """v and its least ``keep`` ids. The rank's limit is applied before the
    exchange too, so a vector of very many rows does not meet in one task."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    return rows.withColumn("r", rank).where(F.col("r") <= keep).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def placed(vectors: DataFrame, pivots: dict[int, np.ndarray], blocks: dict[tuple[int, int], int] | None = None) -> DataFrame:
    """Adds dim and pivot: the nearest pivot of the vector's dimension."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            vs = [np.array(v, float) for v in b.column("v").to_pylist()]
            dims = np.array([len(v) for v in vs])
            near = np.zeros(len(vs), np.int64)
            for d in np.unique(dims):
                some, p = np.flatnonzero(dims == d), shared.value.get(int(d))
                if p is not None:
                    x = np.stack([vs[k] for k in some])
                    near[some] = ((p * p).sum(1) - 2 * x @ p.T).argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dims, pa.int32()), pa.array(near, pa.int32())], [*b.schema.names, "dim", "pivot"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(run, f"{kinds}, dim int, pivot int")


def in_blocks(rows: DataFrame) -> DataFrame:
    """(dim, pivot, block): vectors of a pivot are dealt to blocks of about BLOCK."""
    sizes = rows.groupBy("dim", "pivot").agg(F.count("*").alias("size"))
    return rows.join(sizes, ["dim", "pivot"]).withColumn("block", F.pmod(F.xxhash64("v"), F.ceil(F.col("size") / BLOCK).cast("long")).cast("int")).drop("size")


def packed(rows: DataFrame) -> DataFrame:
    """A row a block: its vectors and ids as binary, and its ball (centre, radius)."""
    def run(table: pa.Table) -> pa.Table:
        x = np.stack([np.array(v, np.int64) for v in table.column("v").to_pylist()])
        ids = table.column("ids").to_pylist()
        wide = np.full((len(ids), max(map(len, ids))), NO_ID)
        for k, own in enumerate(ids):
            wide[k, : len(own)] = own
        centre = x.mean(0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(1)).max())
        kind = np.int16 if np.abs(x).max() < 1 << 15 else np.int64
        one = {c: [table.column(c)[0].as_py()] for c in ("dim", "pivot", "block")}
        return pa.table({**{c: pa.array(v, pa.int32()) for c, v in one.items()}, "n": pa.array([len(x)], pa.int32()), "width": pa.array([np.dtype(kind).itemsize], pa.int32()),
                         "x": pa.array([x.astype(kind).tobytes()], pa.binary()), "ids": pa.array([wide.tobytes()], pa.binary()), "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": pa.array([radius], pa.float64())})

    return rows.groupBy("dim", "pivot", "block").applyInArrow(run, "dim int, pivot int, block int, n int, width int, x binary, ids binary, centre array<double>, radius double")


def _unpacked(row: dict, side: str) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(row[f"x_{side}"], np.dtype(f"i{row[f'width_{side}']}")).reshape(row[f"n_{side}"], -1).astype(float)
    return x, np.frombuffer(row[f"ids_{side}"], np.int64).reshape(row[f"n_{side}"], -1)


def met(pairs: DataFrame, keep: int) -> DataFrame:
    """Search each row's candidate block for its query block; (query, id, score) of
    each query's best ``keep``. ``query``: the least id of its vector."""
    def run(batches: Iterator[pa.RecordBatch]):
        trees: dict[tuple, tuple] = {}

        def tree(row, side):
            key = (side, *[row[f"{c}_{side}"] for c in ("dim", "pivot", "block")])
            if key not in trees:
                if len(trees) > 64:
                    trees.clear()
                x, ids = _unpacked(row, side)
                made = CoverTree(x)
                trees[key] = made, ids[made.order]
            return trees[key]

        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                queries, qids = tree(row, "q")
                candidates, ids = tree(row, "c")
                best = Best(len(qids), keep)
                if row["floor"] is not None:
                    best.score[:] = row["floor"] - 0.5  # scores are whole: nothing at the floor is lost
                search(queries, candidates, ids, best)
                real = best.id != NO_ID
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids[:, 0], real.sum(1))), pa.array(best.id[real]), pa.array(best.score[real].astype(np.int64))], ["query", "id", "score"])

    sides = [f"{c}_{s}" for s in "qc" for c in ("dim", "pivot", "block", "n", "width", "x", "ids")]
    return pairs.select(*sides, "floor").mapInArrow(run, "query long, id long, score long")


def top_k(df: DataFrame, queries: DataFrame, k: int = K, id_column: str = "vec_id", column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` the k candidates
    of ``df`` with the highest inner products, itself excluded by id."""
    rows, asked = whole_vectors(df, id_column, column, scale), whole_vectors(queries, id_column, column, scale)
    keep = k + 1
    vectors = written(distinct_vectors(rows, keep), "vectors")
    n = vectors.count()
    sample = few_by_hash(vectors.withColumn("dim", F.size("v")), ["v"], PIVOTS, n).collect()
    few = max(1, min(PIVOTS, n // PER_PIVOT))
    pivots = {d: np.array([r["v"] for r in sample if r["dim"] == d][:few], float) for d in {r["dim"] for r in sample}}
    heads = distinct_vectors(asked, 1)
    side = lambda t, s: t.select(*[F.col(c).alias(f"{c}_{s}") for c in t.columns])
    cands = side(written(packed(in_blocks(written(placed(vectors, pivots), "placed"))), "candidates"), "c")
    asks = side(written(packed(in_blocks(written(placed(heads, pivots), "placed"))), "queries"), "q")
    # first round: the candidates of the queries' own pivots
    home = asks.join(cands, (F.col("dim_q") == F.col("dim_c")) & (F.col("pivot_q") == F.col("pivot_c"))).withColumn("floor", F.lit(None).cast("double"))
    first = written(met(home.repartition("pivot_c", "block_c", "block_q"), keep), "first")
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    kth = first.withColumn("r", F.row_number().over(ranked)).where(F.col("r") == keep).select("query", F.col("score").alias("kth"))
    # each query block's worst k-th score; a query with fewer has none
    block_of = placed(heads, pivots)
    floors = (in_blocks(block_of).select("dim", "pivot", "block", F.element_at("ids", 1).alias("query")).join(kth, "query", "left")
              .groupBy("dim", "pivot", "block").agg(F.when(F.count("kth") == F.count("*"), F.min("kth").cast("double")).alias("floor")))
    floors = floors.select(F.col("dim").alias("dim_q"), F.col("pivot").alias("pivot_q"), F.col("block").alias("block_q"), "floor")
    # second round: block pairs that can still matter; first by their balls alone, then with the vectors
    balls_q = asks.select("dim_q", "pivot_q", "block_q", "centre_q", "radius_q").join(floors, ["dim_q", "pivot_q", "block_q"])
    balls_c = cands.select("dim_c", "pivot_c", "block_c", "centre_c", "radius_c")
    dot = F.aggregate(F.zip_with("centre_q", "centre_c", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(F.col(c), F.lit(0.0), lambda s, x: s + x * x))
    most = dot + norm("centre_q") * F.col("radius_c") + norm("centre_c") * F.col("radius_q") + F.col("radius_q") * F.col("radius_c")
    far = (balls_q.join(balls_c, (F.col("dim_q") == F.col("dim_c")) & (F.col("pivot_q") != F.col("pivot_c"))).where(F.col("floor").isNull() | (most * (1 + 1e-9) + 1e-6 >= F.col("floor")))
           .select("dim_q", "pivot_q", "block_q", "pivot_c", "block_c", "floor"))
    wide = far.join(asks, ["dim_q", "pivot_q", "block_q"]).join(cands.withColumnRenamed("dim_c", "dim_q"), ["dim_q", "pivot_c", "block_c"]).withColumn("dim_c", F.col("dim_q"))
    second = met(wide.repartition("pivot_c", "block_c", "pivot_q", "block_q"), keep)
    best = first.union(second).withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= keep).select("query", "id", "score")
    # from distinct vectors back to all queries; their own id goes
    each = asked.join(heads.select("v", F.element_at("ids", 1).alias("query")), "v").select("id", "query").withColumnRenamed("id", "query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return each.join(best, "query").where("id <> query_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
