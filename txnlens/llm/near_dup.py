"""MinHash near-duplicates by fast similarity sketching.

A document's set is its distinct 5-word shingles (fewer words: the sequence as
one). The sketch has T coordinates, filled in rounds: in each of the first T
rounds every element is hashed to one coordinate and a value, and a coordinate
keeps the least value of the first round that reached it; in the next T rounds
every element goes to the coordinate of the round's number. So every coordinate
is filled, after one or two rounds for all but short texts, and the share of equal
coordinates estimates the similarity with Chernoff bounds like those of T
independent hash functions. R coordinates make a band; a pair at similarity
0.75 shares none of the 32 bands of 4 with probability 5e-6.

Work after the sketches, all of it joins and aggregations:

1. documents with equal sets are one class, a node of the graph with a number of
   its own, stood for by a row with its least id;
2. each band has its buckets; in every bucket one member is its centre, the first in
   one random order of all nodes, and all members are compared with that centre, not
   with each other. As the order is the same for all bands, the members of a large
   family meet the same few centres again and again, which are few distinct pairs;
3. pairs whose sketches agree on too few coordinates (five standard deviations
   below 0.75) are put aside; the others are confirmed on the full sets, and
   confirmed links are contracted to components. A second round, for members that are
   not in their centre's component, has another order in every bucket;
4. buckets that still hold more than one component compare the members outside their
   largest one with all others, in blocks: first on sketches alone, which names the
   members that are worth their texts, then on the full sets; only links come out.

Defined results: null, empty and blank texts have empty sets and are linked with
nothing; rows that repeat a doc_id each keep their row and are grouped by their
own text, so two groups that are not linked can have the same least id; a null
doc_id is a document of its own, never linked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, map_rows, mix64, steps, words_of, written

SHINGLE, T, R = 5, 128, 4
BANDS = T // R
#: Confirmed: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Sketches of a pair at 0.75 agree on fewer coordinates with probability 3e-7.
LEAST_AGREE = 71
WORD_MEMO = 300_000
#: Members of a bucket, and shingles of them, that make a block; one task compares two blocks.
BLOCK, BLOCK_VOLUME = 1024, 2_000_000
#: Bytes of text of one numpy step.
STEP_CHARS = 4 << 20


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_MEMO:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


def word_hashes() -> WordHashes:
    return held(("words",), WordHashes)


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(elements, sizes): each text's distinct shingles as sorted 64-bit numbers."""
    known = word_hashes()
    docs = [words_of(t) for t in texts]
    sizes = np.array([len(d) for d in docs], np.int64)
    flat = np.fromiter((known[w] for d in docs for w in d), np.uint64, int(sizes.sum()))
    short = (sizes > 0) & (sizes < SHINGLE)
    counts = np.where(short, 1, np.maximum(sizes - SHINGLE + 1, 0))
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    owner = np.repeat(np.arange(len(docs)), counts)
    first = np.repeat(starts, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    length = np.minimum(sizes, SHINGLE)[owner]
    with np.errstate(over="ignore"):
        h = length.astype(np.uint64)
        for k in range(SHINGLE):
            step = mix64(h + np.uint64(0x632BE59BD9B4E019), 7) ^ (flat[np.minimum(first + k, max(len(flat) - 1, 0))] if len(flat) else h)
            h = np.where(length > k, mix64(step, 11), h)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[fresh], np.bincount(owner[fresh], minlength=len(docs)).astype(np.int64)


def sketches(elements: np.ndarray, sizes: np.ndarray, t: int = T) -> np.ndarray:
    """A row of ``t`` 32-bit values for each set; empty sets have zeros."""
    n = len(sizes)
    best = np.full(n * t, np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    todo = sizes > 0
    for r in range(2 * t):
        if not todo.any():
            break
        mine = todo[owner]
        if not mine.all():
            elements, owner = elements[mine], owner[mine]
        with np.errstate(over="ignore"):
            h = mix64(elements, 1000 + r)
        bins = (h >> np.uint64(32)).astype(np.int64) % t if r < t else np.full(len(h), r - t)
        cell = owner * t + bins
        value = np.uint64(r) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))
        free = best[cell] >= np.uint64(r) << np.uint64(32)  # filled in this round or not yet
        np.minimum.at(best, cell[free], value[free])
        todo &= (best.reshape(n, t) == np.iinfo(np.uint64).max).any(1)
    best[best == np.iinfo(np.uint64).max] = 0
    with np.errstate(over="ignore"):
        return (mix64(best, 5) & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(n, t)


def text_key():
    """Tells the texts of a repeated id apart."""
    return F.xxhash64("text").alias("text_key")


def sketch_documents(df: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """id, text_key (a hash of the text), n_shingles, set_key (128 bits of the whole
    set), sketch (binary, 16 bits a coordinate) and bands (a 64-bit number each)."""
    def run(batches):
        for whole in batches:
            for b in steps(whole, 1, STEP_CHARS):
                elements, sizes = shingle_sets(b.column(1).to_pylist())
                sk = sketches(elements, sizes)
                with np.errstate(over="ignore"):
                    ends = np.cumsum(sizes)
                    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(elements, s), dtype=np.uint64)]) for s in (21, 22)]
                    keys = np.column_stack([s[ends] - s[ends - sizes] for s in sums])
                    bands = np.zeros((len(sizes), BANDS), np.uint64)
                    for k in range(R):
                        bands = mix64(bands ^ sk[:, k::R][:, :BANDS].astype(np.uint64), 31 + k)
                    bands = mix64(bands + np.arange(BANDS, dtype=np.uint64), 41)
                low = sk.astype(np.uint16)
                yield pa.RecordBatch.from_arrays([
                    b.column(0), b.column(2), pa.array(sizes, pa.int64()), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array([s.tobytes() for s in low], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS), pa.int32()), pa.array(bands.reshape(-1).view(np.int64)))],
                    ["id", "text_key", "n_shingles", "set_key", "sketch", "bands"])

    return map_rows(df.select(F.col(id_column).cast("long").alias("id"), "text", text_key()), ["id", "text", "text_key"],
                    "id long, text_key long, n_shingles long, set_key binary, sketch binary, bands array<long>", run)


def agreement(left: str, right: str):
    """Equal coordinates of two sketch columns."""
    @F.pandas_udf("int")
    def agree(a, b):
        import pandas as pd
        x = np.frombuffer(b"".join(a), np.uint16).reshape(-1, T)
        y = np.frombuffer(b"".join(b), np.uint16).reshape(-1, T)
        return pd.Series((x == y).sum(1).astype(np.int32))

    return agree(left, right)


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of (a, b) those that are links on their full sets. ``docs``: id, text, one
    row an id. Each pair meets both texts by joins on the ids."""
    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                left, right = b.column(2), b.column(3)
                codes = [c.dictionary_encode() for c in (left, right)]
                sets = []
                for c in codes:
                    elements, sizes = shingle_sets(c.dictionary.to_pylist())
                    sets.append(np.split(elements, np.cumsum(sizes)[:-1]))
                ok = []
                for x, y in zip(codes[0].indices.to_pylist(), codes[1].indices.to_pylist()):
                    p, q = sets[0][x], sets[1][y]
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    ok.append(100 * both >= PERCENT * (len(p) + len(q) - both))
                keep = np.flatnonzero(ok)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), b.column(1).take(pa.array(keep))], ["a", "b"])

    named = lambda k: docs.select(F.col("id").alias(k), F.col("text").alias(f"text_{k}"))
    wide = pairs.join(named("b"), "b").join(named("a"), "a")
    return wide.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id of ``links`` (a, b): least reachable id. Each
    round gives every id the least label around it, then the label of its label;
    both halve distances, and both are joins and aggregations on the links."""
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    label = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("id"), "label")
    while True:
        label = written(label, "labels")
        at = label.select(F.col("id").alias("b"), F.col("label").alias("near"))
        least = both.join(at, "b").groupBy("a").agg(F.min("near").alias("near")).select(F.col("a").alias("id"), "near")
        step = label.join(least, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = label.select(F.col("id").alias("mid"), F.col("label").alias("far"))
        new = written(step.join(jump, "mid", "left").select("id", "old", F.least("mid", F.coalesce("far", "mid")).alias("label")), "labels")
        if new.where("old <> label").limit(1).count() == 0:
            return new.select("id", F.col("label").alias("component"))
        label = new.select("id", "label")


def meetings(rows: DataFrame, mixed: DataFrame) -> DataFrame:
    """``rows`` (band, bucket, id, component, ...) of the ``mixed`` buckets (band,
    bucket, largest, blocks), each once for every block of the other side that it
    meets: members outside the largest component are in blocks of their own kind and
    meet all blocks, so a bucket of n members with m outside is about
    n + m * n / BLOCK rows. Adds i and j (the block of either side) and ``out``."""
    placed = rows.join(mixed, ["band", "bucket"]).withColumn("out", F.col("component") != F.col("largest"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    mine = F.pmod(F.xxhash64("id"), F.col("out_blocks")).cast("int")
    # side 0: outside members, to every block; side 1: every member, to every block of outside members
    sides = F.array(F.struct(F.lit(0).alias("side"), F.expr("sequence(0, blocks - 1)").alias("others")), F.struct(F.lit(1).alias("side"), F.expr("sequence(0, out_blocks - 1)").alias("others")))
    both = placed.withColumn("own", own).withColumn("mine", mine).select("*", F.explode(sides).alias("s")).where("out OR s.side = 1")
    return both.select("*", F.explode("s.others").alias("other")).select(
        *rows.columns, F.col("s.side").alias("side"), F.when(F.col("s.side") == 0, F.col("mine")).otherwise(F.col("other")).alias("i"),
        F.when(F.col("s.side") == 0, F.col("other")).otherwise(F.col("own")).alias("j"))


def near_in_block(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of one meeting: rows of side 0 and, for each, the rows of side 1 that are in
    another component and agree with it on LEAST_AGREE coordinates. A pair is looked at
    in the first band that it shares."""
    comp, side = table.column("component").to_numpy(), table.column("side").to_numpy()
    sk = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(-1, T)
    bands = np.array(table.column("bands").combine_chunks().flatten()).reshape(-1, BANDS)
    band = table.column("band")[0].as_py()
    outside, rest = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    near = []
    for k in outside:
        to = rest[comp[rest] != comp[k]]
        to = to[(sk[to] == sk[k]).sum(1) >= LEAST_AGREE]
        near.append(to[(bands[to] == bands[k]).argmax(1) == band] if to.size else to)
    return outside, near


def across(rows: DataFrame, mixed: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) of the ``mixed`` buckets between different components, confirmed on
    the full sets. ``rows``: band, bucket, id, component, sketch, bands. Sketches tell
    which members are worth their texts; components that a link joins in a meeting are
    one from then on. Only links leave it."""
    place = ["band", "bucket", "i", "j"]
    met = meetings(rows, mixed)

    def worth(table: pa.Table) -> pa.Table:
        outside, near = near_in_block(table)
        used = [outside[[n.size > 0 for n in near]], *near] if near else []
        keep = np.unique(np.concatenate(used)).astype(np.int64) if used else np.zeros(0, np.int64)
        return table.select([*place, "id", "component", "sketch", "bands", "side"]).take(pa.array(keep))

    def links(table: pa.Table) -> pa.Table:
        outside, near = near_in_block(table)
        ids, comp = table.column("id").to_numpy(), table.column("component").to_numpy().copy()
        elements, sizes = shingle_sets(table.column("text").to_pylist())
        number = np.unique(elements, return_inverse=True)[1]
        ends = np.cumsum(sizes)
        mark = np.zeros(int(number.max()) + 1 if len(number) else 1, bool)
        a, b = [], []
        for k, to in zip(outside, near):
            to = to[comp[to] != comp[k]]
            if not to.size:
                continue
            own = number[ends[k] - sizes[k]: ends[k]]
            mark[own] = True
            spans = [number[ends[r] - sizes[r]: ends[r]] for r in to]
            both = np.add.reduceat(mark[np.concatenate(spans)].astype(np.int64), np.cumsum([0, *map(len, spans[:-1])]))
            mark[own] = False
            for r in to[100 * both >= PERCENT * (len(own) + sizes[to] - both)]:
                if comp[r] != comp[k]:
                    a.append(min(ids[k], ids[r]))
                    b.append(max(ids[k], ids[r]))
                    comp[comp == comp[r]] = comp[k]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    schema = "band int, bucket long, i int, j int, id long, component long, sketch binary, bands array<long>, side int"
    some = met.select(*place, "id", "component", "sketch", "bands", "side").groupBy(*place).applyInArrow(worth, schema)
    return some.join(texts, "id").groupBy(*place).applyInArrow(links, "a long, b long").distinct()


def near_duplicates(df: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Per row: id, n_shingles, component_id and kept (the row's id is the least
    reachable one)."""
    out = grouped(df, id_column)
    return out.select(F.col("id").alias(id_column), "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"))


def one_of_each(df: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, text_key, n): the row with the least id of every group, the least
    text_key of its texts, and how many rows are equal to it in both. Rows without
    words or id are not in it."""
    rows = grouped(df, id_column).where("n_shingles > 0 AND id IS NOT NULL").groupBy("group", "id", "text_key").agg(F.count("*").alias("n"))
    return rows.groupBy("group").agg(F.min(F.struct("id", "text_key", "n")).alias("least")).select("least.*")


def without_copies(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row of each group, one with its least id, all its columns as they are; rows
    that repeat an id go by their own texts. Rows without words or without an id stay."""
    kept = written(one_of_each(docs, id_column).select(F.col("id").alias("_id"), F.col("text_key").alias("_key"), F.col("n").alias("_n")), "kept")
    real = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)) & F.col(id_column).isNotNull()
    own = (F.col(id_column).cast("long") == F.col("_id")) & (text_key() == F.col("_key"))
    single = docs.where(real).join(kept.where("_n = 1"), own, "left_semi")
    repeated = docs.where(real).join(kept.where("_n > 1"), own).dropDuplicates(["_id", "_key"]).select(*docs.columns)
    return single.unionByName(repeated).unionByName(docs.where(~real))


def grouped(df: DataFrame, id_column: str) -> DataFrame:
    """Per row: id, text_key, n_shingles, group (the number of a node, null for rows
    without words or id) and component_id (the least id of the group). Nodes are
    classes, so rows that share an id but not a set are not linked by it."""
    docs = df.select(F.col(id_column).cast("long").alias("doc"), "text", text_key())
    sketched = written(sketch_documents(df, id_column), "sketches")
    real = sketched.where("n_shingles > 0 AND id IS NOT NULL")
    # 1. one row a set, whose sketch and bands are those of the class; from here on an id is the number of a node
    heads = real.groupBy("set_key", "n_shingles").agg(F.min(F.struct("id", "text_key")).alias("least"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    heads = written(heads.select(F.monotonically_increasing_id().alias("id"), F.col("least.id").alias("doc"), F.col("least.text_key").alias("text_key"),
                                 "set_key", "n_shingles", "sketch", "bands"), "heads")
    # 2. buckets of several members
    members = heads.select("id", F.posexplode("bands").alias("band", "bucket"))
    sizes = members.groupBy("band", "bucket").agg(F.min(F.struct(F.xxhash64("id").alias("h"), "id")).alias("c"), F.count("*").alias("size")).where("size > 1")
    shared = written(members.join(sizes.select("band", "bucket", F.col("c.id").alias("centre")), ["band", "bucket"]), "buckets")
    places = heads.select("id", "doc", "text_key").join(shared.select("id").distinct(), "id", "left_semi")
    texts = written(docs.join(places, ["doc", "text_key"]).select("id", "text").dropDuplicates(["id"]), "texts")
    # 3. by sketch, then on the full sets; a second round for those that are not with their centre yet (two members have met)
    sk = lambda k: heads.select(F.col("id").alias(k), F.col("sketch").alias(f"sketch_{k}"))

    def linked(pairs: DataFrame) -> DataFrame:
        ordered = pairs.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
        likely = ordered.join(sk("b"), "b").join(sk("a"), "a").where(agreement("sketch_a", "sketch_b") >= LEAST_AGREE).select("a", "b")
        return written(confirmed(likely, texts), "links")

    def labelled(links: DataFrame) -> DataFrame:
        label = heads.select("id", "n_shingles").join(components(links), "id", "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component"))
        return shared.select("band", "bucket", "id").join(label, "id")

    links = linked(shared.where("id <> centre"))
    first = written(labelled(links), "labelled")
    other = first.groupBy("band", "bucket").agg(F.min(F.struct(F.xxhash64("band", "bucket", "id").alias("h"), "id", "component")).alias("c"),
                                                F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo < hi AND size > 2")
    again = first.join(other.select("band", "bucket", "c"), ["band", "bucket"]).where("component <> c.component").select("id", F.col("c.id").alias("centre"))
    links = written(links.union(linked(again)), "links")
    found = components(links)
    # 4. buckets that still hold several components
    label = written(labelled(links), "labelled")
    of = label.groupBy("band", "bucket", "component").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("volume"))
    mixed = of.groupBy("band", "bucket").agg(F.max(F.struct("size", "volume", "component")).alias("top"), F.sum("size").alias("size"), F.sum("volume").alias("volume"),
                                             F.count("*").alias("several")).where("several > 1 AND size > 2")
    blocks = lambda n, v: F.greatest(F.ceil(n / BLOCK), F.ceil(v / BLOCK_VOLUME)).cast("int")
    mixed = mixed.select("band", "bucket", F.col("top.component").alias("largest"), blocks(F.col("size"), F.col("volume")).alias("blocks"),
                         blocks(F.col("size") - F.col("top.size"), F.col("volume") - F.col("top.volume")).alias("out_blocks"))
    more = written(across(label.drop("n_shingles").join(heads.select("id", "sketch", "bands"), "id"), mixed, texts), "across")
    if more.limit(1).count():
        links = links.union(more)
        found = components(links)
    # back to all rows
    least = found.join(heads.select("id", "doc"), "id").groupBy("component").agg(F.min("doc").alias("least"))
    lead = heads.select("id", "doc", "set_key", "n_shingles").join(found.join(least, "component"), "id", "left").select(
        "set_key", "n_shingles", F.coalesce("component", "id").alias("group"), F.coalesce("least", "doc").alias("least"))
    out = sketched.join(lead, ["set_key", "n_shingles"], "left")
    real = (F.col("n_shingles") > 0) & F.col("id").isNotNull()
    return out.select("id", "text_key", "n_shingles", F.when(real, F.col("group")).alias("group"), F.when(real, F.col("least")).otherwise(F.col("id")).alias("component_id"))
