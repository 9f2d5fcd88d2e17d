"""Periodic runs: against all stretches of all periods, the SQL and edge cases."""

import hashlib
import random

import duckdb
import pandas as pd
import pytest

from txnlens.llm import runs
from txnlens.llm.oracles import periodic_runs
from txnlens.llm.queries import QUERIES


def plain(words):
    n, out = len(words), set()
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if j > i and length >= max(6, 4 * q):
                own = words[start: start + length]
                if all(own[r:] != own[:-r] for r in range(1, q)):
                    out.add((start, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def made_up(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        words = [rng.randint(0, rng.choice([1, 2, 2, 3])) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            a = rng.randint(0, len(words))
            words[a:a] = words[a: a + rng.randint(1, 7)] * rng.randint(2, 7)
        yield words


def test_runs_are_all_maximal_stretches():
    found = 0
    for words in made_up(5000, 1):
        own = runs.runs_of(words)
        assert own == plain(words), words
        found += len(own)
    assert found > 3000


def test_last_places_are_those_of_the_suffixes():
    """Every path segment: its longest suffix ended last at its colour, a longer one earlier."""
    for words in made_up(300, 2):
        automaton = runs.Automaton(words)
        places = runs.LastPlaces(automaton.link)
        for place, state in enumerate(automaton.prefix):
            last = {}
            for length in range(1, place + 2):
                own = words[place + 1 - length: place + 1]
                last[length] = max((e for e in range(length - 1, place) if words[e + 1 - length: e + 1] == own), default=-1)
            met = [(automaton.longest[s], e) for s, e in places.access(state, place) if s]
            lengths = [0, *sorted(x for x, _ in met)]
            assert lengths[-1] == place + 1
            for (longest, e), shorter in zip(sorted(met), lengths):
                assert all(last[k] == e for k in range(shorter + 1, longest + 1))


def test_words_cut_out_are_in_no_run():
    for words in made_up(500, 3):
        doc = [f"once{k}" if k % 11 == 5 else w for k, w in enumerate(words)]
        assert runs.runs_of(doc) == plain(doc)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text, change=runs.spliced):
    words = change(doc_id, (text or "").encode().split())
    own = plain(words)
    dropped = {k for s, n, q in own for k in range(s + q, s + n)}
    best = min(own, key=lambda r: (-r[1], r[0], r[2]), default=None)
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(own), *top, sha("".join(f"{s},{n},{q}\n" for s, n, q in own)), sha(b" ".join(w for k, w in enumerate(words) if k not in dropped).decode()))


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: tuple(r) for r in QUERIES["op12_runs"](spark, sf).collect()}
    assert len(got) == len(docs)
    few = [d for d in docs if len(d.text or "") < 4000]
    assert len(few) > 100 and all(got[d.doc_id] == expected(d.doc_id, d.text) for d in few)
    assert sum(r[1] > 0 for r in got.values()) > 5


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    texts = [" ".join(f"w{w}" for w in words) for words in made_up(400, 5)]
    return [(rng.randint(0, 3000) - 1000, t) for t in texts] + [(None, "a a a a a a b"), (1, None), (1, ""), (1, " \t\n "), (2, "x y x y x y x y"), (2, "x y x y x y x y"), (3, "Ab ab Ab ab Ab ab Ab ab\x1c Ab")]


def test_edges_and_sql(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, start int, collapsed string").repartition(3)
    out = runs.run_digest(runs.periodic_runs(docs, change=runs.spliced))
    got = sorted(map(str, map(tuple, out.collect())))
    assert got == sorted(str(expected(i, t)) for i, t in rows)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    assert sorted(map(str, con.execute(f"SELECT {', '.join(out.columns)} FROM ({periodic_runs(runs.LEAST_WORDS, runs.LEAST_PERIODS)})").fetchall())) == got
    assert runs.run_digest(runs.periodic_runs(docs.limit(0))).count() == 0


def test_long_text_in_linear_state():
    words = [f"u{k}" for k in range(300_000)] + ["x", "y", "z"] * 20_000
    assert runs.runs_of(words) == [(300_000, 60_000, 3)]
    assert len(runs.collapsed(words, runs.runs_of(words))) == 300_003
