"""Each registered query over the whole small tables against a plain version."""

import hashlib
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from txnlens.llm.queries import CONTROL_TEXT, ORACLES, QUERIES, WORD_BPE


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sf():
    return SF


@pytest.fixture(scope="module")
def rows(sf):
    """The text tables as lists of dicts."""
    return lambda name: pq.read_table(f"{sf}/{name}.parquet").to_pylist()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def got(spark, sf, name, key):
    return {r[key]: r.asDict() for r in QUERIES[name](spark, sf).collect()}


def test_bpe(spark, sf, rows):
    tok, out = Tokenizer.from_file(WORD_BPE), got(spark, sf, "op1_bpe", "doc_id")
    docs = rows("documents")
    assert len(out) == len(docs)
    for d in docs:
        ids = tok.encode(d["text"] or "", add_special_tokens=False).ids
        r = out[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))


def test_chat(spark, sf, rows):
    out, by = got(spark, sf, "op2_chat", "conv_id"), {}
    turns = rows("conversations") + [{"conv_id": -1, "turn": k, "role": r, "text": CONTROL_TEXT} for k, r in enumerate(("user", "assistant"))]
    for t in sorted(turns, key=lambda t: (t["conv_id"], t["turn"])):
        by.setdefault(t["conv_id"], []).append((t["role"], t["text"] or ""))
    assert set(out) == set(by)
    for conv, own in by.items():
        loss = "".join(x for r, x in own if r == "assistant")
        r = out[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(own), sha("".join(f"{r}\n{x}\n" for r, x in own)), len(loss), sha(loss))
        assert r["formatted_chars"] >= sum(len(x) for _, x in own) + 2 * len(own)


def test_topk(spark, sf, rows):
    vecs = {r["vec_id"]: np.floor(64 * np.array(r["embedding"], float)) for r in rows("embeddings")}
    ids = np.array(sorted(vecs))
    m = np.stack([vecs[i] for i in ids])
    out = {}
    for r in QUERIES["op3_topk"](spark, sf).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(out) == {i for i in ids.tolist() if i % 20 == 0}
    for q, found in out.items():
        s = m @ vecs[q]
        best = [int(k) for k in np.lexsort((ids, -s)) if ids[k] != q][:20]
        assert sorted(found) == [(j + 1, int(ids[k]), int(s[k])) for j, k in enumerate(best)]


def test_lm(spark, sf, rows):
    out, docs = got(spark, sf, "op4_lm", "doc_id"), rows("documents")
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    held = lambda d: zlib.crc32(str(d["doc_id"]).encode()) % 7 == 2
    c = Counter(w for d in docs if not held(d) for w in words(d["text"]))
    n, v = sum(c.values()), len(c)
    better = 0
    for d in docs:
        r, w = out[d["doc_id"]], words(d["text"])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(d), len(w), sum(x in c for x in w), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        better += r["score"] > r["base_score"]
    assert sum(out[d["doc_id"]]["score"] for d in docs if held(d)) > sum(out[d["doc_id"]]["base_score"] for d in docs if held(d))


BASE = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), 20), ("hex", re.compile("[0-9a-f]+"), 24)]


def base_spans(text):
    return sorted((m.start(), k, m.end()) for k, (kind, p, least) in enumerate(BASE) for m in p.finditer(text or "") if len(m[2] if k == 0 else m[0]) >= least)


def test_secrets(spark, sf, rows):
    out = got(spark, sf, "op5_secrets", "doc_id")
    for d in rows("documents"):
        spans = base_spans(d["text"])
        r = out[d["doc_id"]]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in spans) for k in range(3)]
        assert r["base_sha256"] == sha(",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in spans))


def test_decontam(spark, sf, rows):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i in rows("benchmark"):
        w = words(i["text"])
        for k in range(max(1, len(w) - 12)) if w else ():
            windows.setdefault(tuple(w[k: k + 13]), set()).add(i["item_id"])
    out = got(spark, sf, "op6_decontam", "doc_id")
    for d in rows("documents"):
        w, hit, items = words(d["text"]), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k: k + n])):
                    hit.update(range(k, k + n))
                    items |= found
        r = out[d["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (len(w), len(hit), len(items), sha(",".join(sorted(map(str, items)))), len(hit) > 0 and 20 * len(hit) >= len(w))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf, name):
    """The query's rows and types equal its SQL's."""
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = con.execute(ORACLES[name]).fetchall()
    names = [d[0] for d in con.description]
    mine = QUERIES[name](spark, sf)
    assert sorted(names) == sorted(mine.columns)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in mine.collect()))) == sorted(map(str, want))


def test_near_dup(spark, sf, rows):
    sets, docs = {}, rows("documents")
    for d in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), d["text"] or ""))
        sets[d["doc_id"]] = {tuple(w[k: k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * len(sets[a] | sets[b]):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    out = got(spark, sf, "op8_near_dup", "doc_id")
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in out.items()} == {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def test_toxicity(spark, rows):
    out, toxic = got(spark, "/root/testdata/sf0.1", "op9_toxicity", "doc_id"), {}
    for r in pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pylist():
        toxic[r["doc_id"]] = r["toxic"]
    held = [(out[i]["score"], y) for i, y in toxic.items() if i in out and out[i]["held_out"]]
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == r["held_out"] for i, r in out.items())
    bad, good = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([[(a > b) + 0.5 * (a == b) for b in good] for a in bad]) > 0.9
    assert sum(s >= 0.5 for s in bad) > 0.6 * len(bad) and sum(s >= 0.5 for s in good) < 0.05 * len(good)


def test_frames(spark, sf, rows):
    tok, out, at = Tokenizer.from_file(WORD_BPE), got(spark, sf, "op10_frames", "doc_id"), 0
    for d in sorted(rows("documents"), key=lambda d: d["doc_id"]):
        ids = [*tok.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        r = out[d["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
