"""The prefix trie: against a trie of nested dicts, the SQL, tiny sketches and edge cases."""

import hashlib
import random
import zlib

import duckdb
import pandas as pd
import pyarrow as pa
import pytest

from txnlens.llm import prefix_trie as trie
from txnlens.llm.oracles import prefix_trie as sql
from txnlens.llm.queries import QUERIES


def ordered(rows):
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(own)] for c, own in by.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def plain(convs):
    """Rows of the nodes of ``convs`` (id -> turns), by members of every prefix."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for key in members:
        if key:
            children.setdefault(key[:-1], []).append(key)

    def under(key):
        leaves, saved, todo = 0, 0, [key]
        while todo:
            k = todo.pop()
            own = children.get(k, [])
            leaves += not own
            saved += (len(members[k]) - 1) * len(k[-1][1].encode().split()) if k else 0
            todo += own
        return leaves, saved

    out = []
    for key, own in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in own if len(convs[c]) == len(key)))
        out.append((min(own), len(key), min(members[key[:-1]]) if key else None, len(own), len(children.get(key, [])), *under(key), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def made_up(seed, n=60, said=("a b", "c", "", "d e f")):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-45, 130), n):
        for turn in range(rng.randint(1, 6)):
            rows.append((c, rng.choice([turn, turn, turn, None, 1]), rng.choice(["user", "assistant", None]), rng.choice([*said, f"own {c} {turn}", None])))
    return rows


KINDS = "conv_id long, turn long, role string, text string"


def found(spark, rows, shape=trie.respliced_rows, parts=3):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], KINDS + ", depth int, key string").repartition(parts)
    out = trie.prefix_trie(shape(trie.ranked(table)))
    assert out.columns == list(trie.RESULT)
    return sorted(map(str, map(tuple, out.collect())))


@pytest.mark.parametrize("seed", [1, 2])
def test_made_up_conversations_and_sql(spark, seed):
    rows = made_up(seed) + [(None, 0, "user", "a b")]
    rows += rows[:5]
    want = plain(rebuilt(ordered(rows)))
    assert found(spark, rows) == want
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    got = con.execute(f"SELECT {', '.join(trie.RESULT)} FROM ({sql(trie.FAMILY, trie.MOST_SHARED)})").fetchall()
    assert sorted(map(str, got)) == want


def test_conversations_as_they_are(spark):
    rows = made_up(3)
    assert found(spark, rows, trie.plain_rows) == plain(ordered(rows))


def test_tiny_sketch_gives_the_same(spark, monkeypatch):
    """Cells so few that most estimates are too high: more is shuffled, nothing changes."""
    rows = made_up(4, 40, said=("a b", "c"))
    monkeypatch.setattr(trie, "NARROWEST", 8)
    monkeypatch.setattr(trie, "WIDEST", 8)
    monkeypatch.setattr(trie, "PACK", 2)
    assert found(spark, rows) == plain(rebuilt(ordered(rows)))


def test_long_conversations_over_several_partitions(spark):
    """Two conversations of 700 equal turns, a third that leaves them, and a hot first
    turn; ranges are cut inside all of them."""
    long = [(c, t, "user", f"w{t} x") for c in (0, 7, 40) for t in range(700)]
    rows = [*long, (40, 700, "user", "end")] + [r for r in made_up(5, 30)] + [(c, 0, "user", "hello there") for c in range(200, 330)]
    rows = [r for r in rows if r[0] not in (0, 7, 40) or r in long or r[1] == 700]
    assert found(spark, rows, parts=8) == plain(rebuilt(ordered(rows)))


def test_edges(spark):
    one = [(5, 0, None, None)]
    assert found(spark, one, trie.plain_rows) == plain({5: [("", "")]})
    # crc32("5") % 4 turns are taken from conversation 0, which does not exist: turnless or not, it is a member of the root
    assert found(spark, one) == plain(rebuilt({5: [("", "")]}))
    turnless = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    assert found(spark, [(turnless, 0, "user", "x")]) == plain({turnless: []})
    assert found(spark, [(None, 0, "user", "x")]) == []
    empty = spark.createDataFrame([], KINDS)
    assert trie.prefix_trie(trie.respliced_rows(trie.ranked(empty))).count() == 0
    text = "word " * 400_000
    assert found(spark, [(1, 0, "user", text), (2, 0, "user", text)], trie.plain_rows) == plain({1: [("user", text)], 2: [("user", text)]})


def test_sketch_never_estimates_too_low():
    keys = pa.array([bytes([k % 251, k // 251] * 8) for k in range(3000)] + [bytes([k % 251, k // 251] * 8) for k in range(0, 3000, 7)])
    own = trie.CountMin(1 << 12)
    own.add(keys[:1700])
    own.add(keys[1700:])
    shared = own.shared(keys[:3000])
    assert shared[::7].all() and 0 < (~shared).sum()


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    got = sorted(str(tuple(r)) for r in QUERIES["op13_prefix_trie"](spark, sf).collect())
    assert got == plain(rebuilt(ordered(rows)))
