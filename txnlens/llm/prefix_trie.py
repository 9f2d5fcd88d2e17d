"""Conversation prefix trie with count-min screening of prefix digests.

Every prefix of a conversation has a digest: a polynomial over its turns' 128-bit
hashes modulo 2^127 - 1. Digests of consecutive stretches combine, so a conversation
may lie in any number of partitions: turns are range-partitioned and sorted, each
partition makes the digests of its own stretch, and what the stretches before it add is
one row a partition (:func:`ranked`, :func:`paths`). No conversation, node or list of
members is ever gathered in one task.

A count-min sketch over all digests (its width grows with the rows up to ``WIDEST``
cells, counts stop at two) never estimates too low. An estimate of one proves that no
other conversation has the prefix: its node is known from its own row, and so are all
nodes below it, which leave their task at once (:func:`screened`). Only the other
prefixes, and the first of each such tail to learn its parent, are shuffled and grouped
exactly. A node that was only thought to be shared costs a shuffle, nothing else.

Sums over subtrees need no walk through the levels. Every node has a smallest member,
which is a member of all nodes above, too. So the childless nodes, and the saved
tokens, of a subtree are sums over the top node's members of what each is the smallest
member of: one join of the shared prefixes with a row a conversation, and one
aggregation. Parents with many children are few and are broadcast (at most
``MANY`` of them); the others meet theirs by a join. The ids that end at a node are
packed into pieces of ``PACK`` in order, and the pieces are hashed one after the other.

Defined results: rows without a conv_id are left out; ties of a turn go by role, then
text; null roles and texts are empty, a null turn is first; a repeated row is a turn of
its own; an empty table has no nodes; columns beside conv_id, turn, role and text are not
read; a turn of any length counts whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import prefix_sums
from .common import crc_mod, forget, in_batches, mix64, written

MODULUS, BASE = (1 << 127) - 1, 0x5DEECE66D_1B873593_9E3779B9_7F4A7C15 % ((1 << 127) - 1)
#: Count-min: rows of cells, least and greatest cells of a row, cells that travel together.
ROWS, NARROWEST, WIDEST, CHUNK = 4, 1 << 12, 1 << 22, 1 << 16
#: Parents with so great a share of all children are broadcast; there are fewer of them than this.
MANY = 500
#: Ids of a node that travel in one piece.
PACK = 4096
#: A conversation shares the first turns of the one whose id is the next lower multiple of this.
FAMILY, MOST_SHARED = 20, 3
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def in_order(df: DataFrame, *order: str) -> DataFrame:
    return in_batches(df).repartitionByRange(*order).sortWithinPartitions(*order)


def ranked(conversations: DataFrame) -> DataFrame:
    """(conv, r, x, words) per turn: its number within the conversation from 0, the
    16-byte hash of role and text, and the number of words of the text."""
    def run(batches: Iterator[pa.RecordBatch]):
        forget()
        part, first, conv, r = TaskContext.get().partitionId(), None, None, 0
        for b in batches:
            lead, at, hashes, words = [], [], [], []
            for c, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                first = c if first is None else first
                r = r + 1 if c == conv else 0
                conv = c
                name, said = role.encode(), text.encode()
                lead.append(c == first)
                at.append(r)
                hashes.append(xxhash.xxh3_128_digest(b"%d %b%b" % (len(name), name, said)))
                words.append(len(said.split()))
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(at), pa.int32()), b.column(0), pa.array(lead, pa.bool_()), pa.array(at, pa.int64()), pa.array(hashes, pa.binary()), pa.array(words, pa.int64())],
                                             ["part", "conv", "lead", "r", "x", "words"])

    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    local = written(in_order(turns, "conv", "turn", "role", "text").select("conv", "turn", "role", "text").mapInArrow(run, "part int, conv long, lead boolean, r long, x binary, words long"), "turns")
    # one row a partition: its first and last conversation and how far the last one went
    ends = local.groupBy("part").agg(F.min("conv").alias("first"), F.max("conv").alias("last"), F.max_by("r", F.struct("conv", "r")).alias("r")).orderBy("part").collect()
    carry, running = [], (None, 0)
    for e in ends:
        start = running[1] if running[0] == e.first else 0
        carry.append((e.part, start))
        running = (e.last, e.r + 1 + (start if e.last == e.first else 0))
    starts = F.broadcast(local.sparkSession.createDataFrame(carry, "part int, start long"))
    return local.join(starts, "part").select("conv", (F.col("r") + F.when(F.col("lead"), F.col("start")).otherwise(0)).alias("r"), "x", "words")


#: Kinds of rows of a path, in this order: its conversation exists; a turn of another one; an own turn.
EXISTS, SHARED, OWN = 0, 1, 2


def plain_rows(turns: DataFrame) -> DataFrame:
    """(conv, kind, r, x, words): every conversation as it is."""
    return turns.select("conv", F.lit(OWN).alias("kind"), "r", "x", "words").union(_exist(turns))


def respliced_rows(turns: DataFrame) -> DataFrame:
    """As :func:`plain_rows`, but the first h turns are those of the conversation whose
    id is the next multiple of FAMILY towards zero; h is the crc32 of the decimal id
    modulo 4. Shared rows of conversations that do not exist fall out in :func:`paths`."""
    h = crc_mod("conv", MOST_SHARED + 1)
    own = turns.where(F.col("r") >= h).select("conv", F.lit(OWN).alias("kind"), "r", "x", "words")
    aside = F.explode(F.array(*[F.lit(k).cast("long") for k in range(1 - FAMILY, FAMILY)])).alias("aside")
    heads = turns.where((F.col("r") < MOST_SHARED) & (F.col("conv") % FAMILY == 0)).select("*", aside)
    heads = heads.where((F.col("conv") == 0) | (F.signum("conv") * F.signum("aside") >= 0))
    shared = heads.withColumn("conv", F.expr("try_add(conv, aside)")).where(F.col("conv").isNotNull() & (F.col("r") < h)).select(
        "conv", F.lit(SHARED).alias("kind"), "r", "x", "words")
    return own.union(shared).union(_exist(turns))


def _exist(turns: DataFrame) -> DataFrame:
    return turns.where("r = 0").select("conv", F.lit(EXISTS).alias("kind"), F.lit(0).cast("long").alias("r"), "x", F.lit(0).cast("long").alias("words"))


#: Whether a row is the last of its conversation; the last row of a partition cannot know.
GOES_ON, ENDS, OPEN = 0, 1, 2


def paths(rows: DataFrame) -> DataFrame:
    """(conv, depth, key, parent, words, end): one row a prefix of every conversation
    that exists, the empty one included; ``key`` and ``parent`` are digests of 16 bytes,
    ``end`` marks the whole conversation."""
    kinds = "part int, conv long, lead boolean, depth long, key binary, parent binary, words long, state int"

    def run(batches: Iterator[pa.RecordBatch]):
        forget()
        part = TaskContext.get().partitionId()
        conv, begun, pending = None, False, None
        lead = alive = False
        n = d = 0
        for b in batches:
            out = []
            for c, kind, x, words in zip(*(b.column(k).to_pylist() for k in (0, 1, 3, 4))):
                if c != conv:
                    if pending:
                        out.append((*pending, ENDS))
                    lead = not begun and kind != EXISTS  # goes on from the partition before, if at all
                    conv, n, d, pending, begun, alive = c, 0, 0, None, True, lead or kind == EXISTS
                if not alive:
                    continue
                if pending:
                    out.append((*pending, GOES_ON))
                before = d
                if kind != EXISTS:
                    n, d = n + 1, (d * BASE + int.from_bytes(x, "big") + 1) % MODULUS
                pending = (part, c, lead, n, d.to_bytes(16, "big"), before.to_bytes(16, "big"), words)
            yield _batch(out, kinds)
        if pending:
            yield _batch([(*pending, OPEN)], kinds)

    local = written(in_order(rows, "conv", "kind", "r").select("conv", "kind", "r", "x", "words").mapInArrow(run, kinds), "paths")
    last = F.max_by(F.struct("conv", "lead", "depth", "key"), F.struct("conv", "depth")).alias("last")
    ends = local.groupBy("part").agg(F.max(F.when(F.col("lead"), F.col("conv"))).alias("goes_on"), last).orderBy("part").collect()  # one row a partition
    carry: dict[int, tuple[int, int] | None] = {}
    continued: set[int] = set()
    running, before = None, None  # the conversation, depth and digest at the end of the partition before
    for e in ends:
        if e.goes_on is not None:
            carry[e.part] = running[1:] if running and running[0] == e.goes_on else None
            if carry[e.part]:
                continued.add(before)
        n, d, start = e.last.depth, int.from_bytes(e.last.key, "big"), carry.get(e.part)
        if not e.last.lead:
            running = (e.last.conv, n, d)
        else:
            running = (e.last.conv, start[0] + n, _joined(start[1], n, d)) if start else None
        before = e.part
    result = "conv long, depth long, key binary, parent binary, words long, end boolean"

    def finish(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            out = []
            for part, c, lead, depth, key, parent, words, state in zip(*(x.to_pylist() for x in b.columns)):
                if lead:
                    if not (start := carry[part]):
                        continue  # shared turns for a conversation that does not exist
                    parent = _joined(start[1], depth - 1, int.from_bytes(parent, "big")).to_bytes(16, "big")
                    key = _joined(start[1], depth, int.from_bytes(key, "big")).to_bytes(16, "big")
                    depth += start[0]
                out.append((c, depth, key, parent, words, state == ENDS or (state == OPEN and part not in continued)))
            yield _batch(out, result)

    return local.mapInArrow(finish, result)


def _joined(left: int, n: int, right: int) -> int:
    """The digest of a stretch and the ``n`` turns behind it."""
    return (left * pow(BASE, n, MODULUS) + right) % MODULUS


_ARROW = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, (_, k) in zip(columns, fields)], [name for name, _ in fields])


class CountMin:
    """ROWS rows of ``width`` cells that count digests up to two."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.cells = np.zeros(ROWS * width, np.uint8)

    def places(self, keys: pa.Array) -> np.ndarray:
        """(ROWS, keys): the cells of 16-byte keys."""
        halves = np.frombuffer(b"".join(keys.to_pylist()), np.uint64).reshape(-1, 2)
        with np.errstate(over="ignore"):
            a, step = mix64(halves[:, 0], 51) ^ halves[:, 1], mix64(halves[:, 1], 52) | np.uint64(1)
            return np.stack([((a + np.uint64(k) * step) % np.uint64(self.width)).astype(np.int64) + k * self.width for k in range(ROWS)])

    def add(self, keys: pa.Array) -> None:
        for row in self.places(keys):
            cells, times = np.unique(row, return_counts=True)
            self.cells[cells] = np.minimum(self.cells[cells] + np.minimum(times, 2), 2)

    def shared(self, keys: pa.Array) -> np.ndarray:
        """Whether a key may have been added twice; never False for one that was."""
        return (self.cells[self.places(keys)] > 1).all(0) if len(keys) else np.zeros(0, bool)

    def chunks(self) -> Iterator[tuple[int, bytes]]:
        for k in range(0, len(self.cells), CHUNK):
            own = self.cells[k: k + CHUNK]
            if own.any():
                yield k, zlib.compress(own.tobytes(), 1)


def sketch(prefixes: DataFrame, rows: int) -> CountMin:
    """The sketch of the ``key`` column. Tasks add up their own rows, chunks of cells
    meet where they are added, and at most ROWS * WIDEST cells reach the driver."""
    width = min(max(1 << (2 * rows).bit_length(), NARROWEST), WIDEST)

    def count(batches):
        own = CountMin(width)
        for b in batches:
            own.add(b.column(0))
        yield _batch(list(own.chunks()), "at long, chunk binary")

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for at, chunk in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = np.frombuffer(zlib.decompress(chunk), np.uint8)
                sums[at] = np.minimum(sums.get(at, 0) + own, 2).astype(np.uint8)
        yield _batch([(at, zlib.compress(s.tobytes(), 1)) for at, s in sums.items()], "at long, chunk binary")

    local = in_batches(prefixes).select("key").mapInArrow(count, "at long, chunk binary")
    total = CountMin(width)
    for r in local.repartition("at").mapInArrow(add, "at long, chunk binary").collect():
        own = np.frombuffer(zlib.decompress(r["chunk"]), np.uint8)
        total.cells[r["at"]: r["at"] + len(own)] = own
    return total


def screened(prefixes: DataFrame, counts: CountMin) -> DataFrame:
    """``prefixes`` with ``shared`` (another conversation may have the prefix) and
    ``below`` (the prefix one turn shorter is proven to be this conversation's alone)."""
    width, cells = counts.width, prefixes.sparkSession.sparkContext.broadcast(zlib.compress(counts.cells.tobytes(), 1))
    schema = "conv long, depth long, key binary, parent binary, words long, end boolean, shared boolean, below boolean"

    def run(batches):
        own = CountMin(width)
        own.cells = np.frombuffer(zlib.decompress(cells.value), np.uint8)
        for b in batches:
            top = b.column(1).to_numpy() == 1
            below = ~own.shared(b.column(3)) & ~top
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.shared(b.column(2))), pa.array(below)], [*b.schema.names, "shared", "below"])

    return in_batches(prefixes).select("conv", "depth", "key", "parent", "words", "end").mapInArrow(run, schema)


def id_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of (key, conv): the ids of each key in order, joined by
    commas. Ids are packed into pieces where they lie in order, pieces are hashed in
    order."""
    def pack(batches):
        key, ids = None, []
        for b in batches:
            out = []
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != key or len(ids) == PACK:
                    if ids:
                        out.append((key, ids[0], ",".join(map(str, ids))))
                    key, ids = k, []
                ids.append(c)
            yield _batch(out, "key binary, first long, ids string")
        if ids:
            yield _batch([(key, ids[0], ",".join(map(str, ids)))], "key binary, first long, ids string")

    def digest(batches):
        key, own = None, None
        for b in batches:
            out = []
            for k, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if k != key:
                    if own:
                        out.append((key, own.hexdigest()))
                    key, own = k, hashlib.sha256()
                else:
                    own.update(b",")
                own.update(ids.encode())
            yield _batch(out, "key binary, ends_sha256 string")
        if own:
            yield _batch([(key, own.hexdigest())], "key binary, ends_sha256 string")

    pieces = in_order(ends.select("key", "conv"), "key", "conv").mapInArrow(pack, "key binary, first long, ids string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digest, "key binary, ends_sha256 string")


RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(rows: DataFrame) -> DataFrame:
    """The nodes of the trie over :func:`paths` of ``rows``, one row each: conv_id (the
    smallest member), depth, parent_conv_id (the parent's conv_id), n_convs (members),
    n_children, n_leaves (childless nodes below, itself included), saved_tokens (words
    that members but the first repeat, over the subtree), ends_sha256 (members that
    end there)."""
    spark = rows.sparkSession
    whole = written(paths(rows), "prefixes")
    top = whole.where("depth = 0").agg(F.count("*").alias("n"), F.min("conv").alias("least")).first()
    if not top.n:
        return spark.createDataFrame([], ", ".join(f"{c} {'string' if c.endswith('sha256') else 'long'}" for c in RESULT))
    prefixes = whole.where("depth > 0")
    seen = written(screened(prefixes, sketch(prefixes, prefixes.count())), "screened")
    zero, one, words = F.lit(0).cast("long"), F.lit(1).cast("long"), F.col("words")
    own_end = F.when(F.col("end"), F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(F.lit(EMPTY_SHA))
    alone = seen.where("NOT shared")
    tails = alone.where("below OR depth = 1").select(  # complete where they are
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") == 1, F.lit(top.least)).otherwise(F.col("conv")).alias("parent_conv_id"), one.alias("n_convs"),
        F.when(F.col("end"), zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"), own_end.alias("ends_sha256"))
    first = alone.where("NOT below AND depth > 1").select("conv", "depth", "key", "parent", "end")
    both = seen.where("shared")
    nodes = written(both.groupBy("depth", "key").agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id"), F.min("words").alias("words"), F.min("parent").alias("parent"),
                                                     F.max("below").alias("below")), "nodes")
    # children by parent; a tail's first node is a child, too
    children = nodes.where("depth > 1 AND NOT below").select("parent").unionAll(first.select("parent"))
    kids = written(children.groupBy("parent").agg(F.count("*").alias("n_children")), "kids")
    grown = written(nodes.join(kids.withColumnRenamed("parent", "key"), "key", "left").withColumn("n_children", F.coalesce("n_children", zero)), "grown")
    # the leaf that a conversation stands for, and the words it saves as the smallest member
    value = (F.col("n_convs") - 1) * words
    each = written(grown.select(F.col("conv_id").alias("conv"), F.when(F.col("n_children") == 0, one).otherwise(zero).alias("leaf"), value.alias("saved")).unionAll(
        alone.where("end").select("conv", one, zero)).groupBy("conv").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")).where("leaf > 0 OR saved > 0"), "each")
    sums = both.join(each, "conv").groupBy("key").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("under"))
    # what the smallest member saves above a node is not in the node's subtree
    several = grown.where("n_convs > 1").select(F.col("conv_id").alias("conv"), "depth", value.alias("saved"))
    steps = prefix_sums(several, ["conv", "depth"], ["saved"])
    begin = prefix_sums(several.groupBy("conv").agg(F.sum("saved").alias("saved")), ["conv"], ["saved"]).select("conv", (F.col("cum_saved") - F.col("saved")).alias("begin"))
    above = steps.join(begin, "conv").select(F.col("conv").alias("conv_id"), "depth", (F.col("cum_saved") - F.col("saved") - F.col("begin")).cast("long").alias("above"))
    counted = grown.join(sums, "key", "left").join(above, ["conv_id", "depth"], "left").join(
        id_digests(both.where("end").select("key", "conv")), "key", "left")
    counted = written(counted.select("conv_id", "depth", "key", "parent", "below", "n_convs", "n_children", "n_leaves",
                                     F.when(F.col("n_convs") > 1, F.col("under") - F.col("above")).otherwise(zero).alias("saved_tokens"),
                                     F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256")), "counted")
    known = counted.where("below OR depth = 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(top.least)).otherwise(F.col("conv_id"))).select(*RESULT)
    rest = counted.where("NOT below AND depth > 1").select("parent", *[c for c in RESULT if c != "parent_conv_id"]).unionAll(first.select(
        "parent", F.col("conv").alias("conv_id"), "depth", one.alias("n_convs"), F.when(F.col("end"), zero).otherwise(one).alias("n_children"), one.alias("n_leaves"),
        zero.alias("saved_tokens"), own_end.alias("ends_sha256")))
    ids = grown.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    total = kids.agg(F.sum("n_children")).first()[0] or 0
    large = F.broadcast(kids.where(F.col("n_children") >= max(-(-total // MANY), 1)).join(ids, "parent").select("parent", F.col("parent_conv_id").alias("of_large")))
    placed = rest.join(large, "parent", "left")
    found = placed.where("of_large IS NOT NULL").withColumnRenamed("of_large", "parent_conv_id").select(*RESULT).unionAll(
        placed.where("of_large IS NULL").join(ids, "parent").select(*RESULT))
    # the root, from sums that are at hand
    n_children = grown.where("depth = 1").count() + alone.where("depth = 1").count()
    leaves, saved = each.agg(F.sum("leaf")).first()[0], grown.agg(F.sum(value)).first()[0]
    root = spark.createDataFrame([(top.least, 0, None, top.n, n_children, leaves or 1, saved or 0)], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    of_root = id_digests(whole.where("depth = 0 AND end").select("key", "conv")).agg(F.max("ends_sha256").alias("_d"))  # one row, whatever ends there
    root = root.join(F.broadcast(of_root)).withColumn("ends_sha256", F.coalesce("_d", F.lit(EMPTY_SHA))).select(*RESULT)
    return tails.select(*RESULT).unionAll(known).unionAll(found).unionAll(root)
