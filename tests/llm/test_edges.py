"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables
and extra columns with clashing names, for every operator and pipeline stage."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from txnlens.llm import bpe, chat, decontam, frames, lm, near_dup, secret_scan, topk, toxicity, url_filter
from txnlens.llm.queries import BYTE_BPE, WORD_BPE

LONG = " ".join(f"word{k % 997} the token = 'abcdef{k % 7}'" for k in range(30_000))
#: Repeated rows, a null id, a null and an empty text, a text of a megabyte.
TEXTS = [(1, "the cat sat on the mat and more words"), (1, "the cat sat on the mat and more words"), (2, None), (3, ""), (None, "null id text here"), (4, LONG), (5, " \t\n "), (6, "x" * 300_000)]
CLASH = "score double, predicted int, n_tokens int, id string, k0 string, t int, kept int, contaminated string, label int"


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None, None, 0.5, 1, 2, "a", "b", 3, 4, "c", 5) for i, t in TEXTS]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "the cat sat"), (1, "the cat sat"), (2, None), (None, "null id text"), (3, "")], "item_id long, text string")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_bpe(docs, none):
    tok = Tokenizer.from_file(WORD_BPE)
    want = sorted((str(i), len(ids := tok.encode(t or "", add_special_tokens=False).ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))) for i, t in TEXTS)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.bpe_digest(docs, WORD_BPE).collect()) == want
    assert bpe.bpe_digest(none, WORD_BPE).count() == 0
    back = bpe.bpe_decode(bpe.bpe_encode(docs, BYTE_BPE), BYTE_BPE)
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(i), t or "") for i, t in TEXTS)  # byte level: an exact round trip


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_streamed_bpe_equals_the_library(path):
    enc, tok, rng = bpe.StreamEncoder(path), Tokenizer.from_file(path), random.Random(5)
    letters = "aeinrsth" * 3 + "lo'dm1 \n\té😀\x1c​İΣß中文"
    for n in (1, 7, 60, 900, 9000):
        for _ in range(30):
            text = "".join(rng.choices(letters, k=n))
            assert enc.encode(text) == tok.encode(text, add_special_tokens=False).ids
    for text in ("a" * 4000, "th" * 3000 + "e", "<|endoftext|>x<|startoftext|>", "é x́ ΑΣ"):
        assert enc.encode(text) == tok.encode(text, add_special_tokens=False).ids


def test_stream_emits_early():
    """Tokens leave before the word ends, and the buffer does not grow with it."""
    merges = bpe.StreamEncoder(WORD_BPE).merges
    read = 0

    def symbols():
        nonlocal read
        for c in "thein" * 4000:
            read += 1
            yield c

    first = next(merges.stream(symbols()))
    assert read <= 2 * (merges.lookahead + merges.longest) and isinstance(first, int)


def test_byte_decoder_holds_back_incomplete_characters():
    tokens = {k: c for k, c in enumerate(bpe.byte_alphabet())}
    dec = bpe.StreamDecoder(tokens, False)
    assert [dec.feed([b]) for b in "é中".encode()] == ["", "é", "", "", "中"]
    assert dec.feed([0xE4]) == "" and dec.end() == "�" and dec.feed([97]) == "a"


def test_chat(spark):
    rows = [(1, 0, "user", "a </s> \\ [INST] <<SYS>>"), (1, 1, "assistant", "\\</s>\\\\ [/INST]"), (1, 1, "assistant", None), (1, 2, None, "who"), (1, 3, "to[ROLE]ol", "x"), (None, None, "assistant", ""), (2, 0, "system", "s"), (2, 0, "system", "s")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, start int, ids string")
    got = {r.conv_id: r for r in chat.read_back(chat.assembled(df, BYTE_BPE), BYTE_BPE).collect()}
    texts = [("user", rows[0][3]), ("assistant", ""), ("assistant", rows[1][3]), ("", "who"), ("to[ROLE]ol", "x")]
    assert (got[1].n_turns, got[1].turns_sha256) == (5, sha("".join(f"{r}\n{t}\n" for r, t in texts)))
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(rows[1][3]), sha(rows[1][3]))
    assert got[2].n_turns == 2 and got[None].n_turns == 1 and got[None].loss_chars == 0
    assert chat.read_back(chat.assembled(df.limit(0), BYTE_BPE), BYTE_BPE).count() == 0
    made = chat.template(BYTE_BPE)
    for t in (rows[0][3], rows[1][3], "<<s>", "<</SYS>></s>", "\\"):
        assert chat.unescaped(chat.escaped(t)) == t and not any(c in chat.escaped(t) for c in chat.CONTROLS)
        ids = made.segments(["user"], [t])[0][1]
        assert made.rendered(ids) == f"[INST]{chat.escaped(t)}[/INST]" and list(made.turns(ids)) == [("user", t)]
    start, mask = chat.masks([[1, 3, 1], [1, 0, 1], [1, 2, 1, 2, 1]], [True, True, False])
    assert mask.tolist() == [False] + [True] * 3 + [False] * 10 and start.tolist() == [0, 1, 4, 5, 6, 6, 7, 8, 10, 11, 13]


def test_topk(spark):
    rng = np.random.default_rng(6)
    v = {k: rng.normal(size=5).tolist() for k in range(70)}
    v |= {k: [1.0, 2.0, 0.5, -1.0, 0.25] for k in range(100, 140)}  # ties: smaller ids win
    rows = list(v.items()) + [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0]), (202, [float("nan"), 1.0, 1.0, 1.0, 1.0]), (203, [float("inf"), 1.0, 1.0, 1.0, 1.0]), (204, []), (None, v[0]), (0, [1.0, 2.0])]
    rows = [r for r in rows if r != (0, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, score int, rank int")
    for block, pivot in ((2048, 4096), (16, 20)):
        old = topk.BLOCK, topk.PER_PIVOT, topk.LEAF
        topk.BLOCK, topk.PER_PIVOT, topk.LEAF = block, pivot, 4
        got = {}
        for r in topk.top_k(df, df.where("vec_id % 20 = 0"), 20).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        topk.BLOCK, topk.PER_PIVOT, topk.LEAF = old
        whole = {k: np.floor(64 * np.array(x)) for k, x in v.items()}
        for q in [k for k in v if k % 20 == 0]:
            best = sorted(((-int(whole[q] @ x), k) for k, x in whole.items() if k != q))[:20]
            assert sorted(got[q]) == [(j + 1, k, -s) for j, (s, k) in enumerate(best)]
        assert set(got) == {k for k in v if k % 20 == 0}
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    few = topk.top_k(df.where("vec_id < 3"), df.where("vec_id = 0"), 20).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]


def test_cover_tree_invariants():
    points = np.unique(np.floor(np.random.default_rng(8).normal(size=(300, 4)) * 8), axis=0)
    tree = topk.CoverTree(points)
    assert sorted(tree.order) == list(range(len(points)))
    for k, kids in enumerate(tree.children):
        own = tree.points[tree.first[k]: tree.last[k]]
        assert np.sqrt(((own - tree.points[tree.centre[k]]) ** 2).sum(1)).max() <= tree.radius[k] + 1e-9
        if kids:
            assert tree.first[k] == tree.first[kids[0]] and tree.last[k] == tree.last[kids[-1]]
            assert any(tree.centre[c] == tree.centre[k] for c in kids)


def test_lm(docs, none):
    out = lm.lm_scores(docs).collect()
    assert len(out) == len(TEXTS) and all(np.isfinite([r.base_score, r.score]).all() and r.score <= 0 for r in out)
    by = {str(r.doc_id): r for r in out}
    assert by["2"].n_tokens == 1 and by["5"].n_tokens == 1 and by["6"].n_tokens == 2
    assert lm.lm_scores(none).count() == 0


def test_lm_is_normalised(monkeypatch):
    """Probabilities of the classes add up to one after any two words, however many
    blocks they are in."""
    f = lm.Frequent([b"", b"a", b"b", b"c"], np.array([10, 30, 20, 5]), 4, 70, 9)
    for block in (2, 3, 256):
        monkeypatch.setattr(lm, "BLOCK", block)
        m = lm.Model(f)
        m.train(np.array([0 * 25 + 1 * 5 + 2, 2 * 25 + 3 * 5 + 4, 1 * 25 + 1 * 5 + 0]), np.array([5.0, 7.0, 1.0]), np.random.default_rng(1), {n: np.zeros_like(x) for n, x in m.p.items()})
        w2, w1, w = (x.reshape(-1) for x in np.meshgrid(*[np.arange(5)] * 3, indexing="ij"))
        assert np.allclose(np.exp(m.log_prob(w2, w1, w)).reshape(25, 5).sum(1), 1, atol=1e-5)


def test_secrets(docs, none):
    out = secret_scan.scan_secrets(docs).collect()
    by = {str(r.doc_id): r for r in out}
    assert len(out) == len(TEXTS) and by["4"].n_assign == 30_000 and by["2"].n_assign == by["3"].n_assign == 0
    assert secret_scan.scan_secrets(none).count() == 0
    clean = {str(r.doc_id): r for r in secret_scan.redact_secrets(docs).collect()}
    assert clean["2"].text is None and clean["4"].text.count("[SECRET]") == 30_000 and "abcdef" not in clean["4"].text and clean["1"].k0 == "b"
    assert secret_scan.redacted("aXXbYYYc", [(0, 1, 3), (1, 2, 3), (0, 4, 7)], "-") == "a-b-c"


def test_automaton_is_minimal_and_equals_re():
    import re
    dfa = secret_scan.compiled(["(?i:ab|cd)+x{2,3}"], anywhere=False)
    for text in ("abxx", "CDabxxx", "abx", "abxxxx", "xx", "aBcDxx", ""):
        state = dfa.start
        for c in text.encode():
            state = int(dfa.next[state * 256 + c])
        assert bool(dfa.accept[state]) == bool(re.fullmatch("(?i:ab|cd)+x{2,3}", text))
    assert len(dfa.accept) == 8  # start, a, c, pair, x, xx, xxx, dead: a and c lead on by different letters


def test_decontam(docs, none, benchmark):
    by = {}
    for r in decontam.benchmark_hits(docs, benchmark).collect():
        by.setdefault(str(r.doc_id), []).append(r)
    assert [(r.n_words, r.n_hit, r.n_items, r.contaminated) for r in by["1"]] == [(9, 3, 1, True)] * 2
    assert by["1"][0].items_sha256 == sha("1") and by["None"][0].items_sha256 == sha("") and by["None"][0].n_items == 1
    assert (by["2"][0].n_words, by["3"][0].n_words, by["4"][0].n_hit) == (0, 0, 0)
    assert decontam.benchmark_hits(none, benchmark).count() == 0
    assert decontam.benchmark_hits(docs, benchmark.limit(0)).where("n_hit > 0").count() == 0
    whole = sorted(map(str, decontam.benchmark_hits(docs, benchmark).collect()))
    assert sorted(map(str, decontam.benchmark_hits(docs, benchmark, block_words=2).collect())) == whole  # several blocks
    found = decontam.longest_matches(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id, r.words, r.doc_word, r.item_word) for r in found} == {(1, "1", 3, 0, 0), (None, None, 3, 0, 0)}
    assert "score" in decontam.decontaminated(docs, benchmark).columns


@pytest.mark.parametrize("n_docs", [1, 2, 5])
def test_decontam_shards_smaller_than_the_vocabulary(n_docs):
    """Word numbers beyond the shard's length: window sets give the same hits."""
    rng = random.Random(n_docs)
    for _ in range(20):
        items = [[f"w{rng.randrange(6000)}" for _ in range(rng.choice([4, 13, 20, 40]))] for _ in range(400)]
        docs = []
        for _ in range(n_docs):
            doc = []
            for _ in range(rng.randrange(1, 8)):
                own, a = rng.choice(items), rng.randrange(20)
                doc += [*own[a % len(own):], f"w{rng.randrange(6000)}", "other"] if rng.random() < 0.5 else own
            docs.append(doc)
        windows = {}
        for i, w in enumerate(items):
            for k in range(max(1, len(w) - 12)):
                windows.setdefault(tuple(w[k: k + 13]), set()).add(i)
        hits = decontam.Searcher(decontam.Block.of([(i, " ".join(w)) for i, w in enumerate(items)], 13)).search([" ".join(d) for d in docs])
        for d, w in enumerate(docs):
            hit, found = set(), set()
            for n in (4, 13):
                for k in range(len(w) - n + 1):
                    if own := windows.get(tuple(w[k: k + n])):
                        hit.update(range(k, k + n))
                        found |= own
            assert {k for a, b in hits.runs[d] for k in range(a, b)} == hit and set(hits.items[d]) == found


def test_urls(spark, ):
    rows = [(1, None), (2, "no scheme"), (3, "http://"), (4, "HTTP://A.Example.NET/en/1?x#y"), (4, "HTTP://A.Example.NET/en/1?x#y"), (None, "http://b.org/fr/a/b/c/d/e"), (5, "x://c.com#f"), (6, "http://xexample.net/en/"), (7, "http://example.com/de/" + "9" * 100_000)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.judged(df).collect()}
    assert url_filter.judged(df).count() == len(rows) and (got[1].host, got[1].path, got[2].host, got[3].host) == ("", "", "", "")
    assert (got[4].host, got[4].path, got[4].rule, got[4].verdict) == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[None].rule == "org/fr/" and (got[5].host, got[5].path, got[5].rule) == ("c.com", "", None) and got[6].rule == "net/" and got[7].verdict == "block"
    assert url_filter.judged(df.limit(0)).count() == 0


def test_url_templates_learn(spark):
    """A path that rules block on its host is blocked where no rule says so."""
    rows = [(k, f"http://h{k % 3}.example.com/{'de' if k % 2 else 'en'}/{k}") for k in range(900)]
    got = {r.page_id: r.verdict for r in url_filter.judged(spark.createDataFrame(rows, "page_id long, url string"), rules=(("example.com", "/de/1", "block"), ("example.com", "/en/1", "allow"))).collect()}
    assert got[21] == "block" and got[20] == "allow"


def test_near_dup(docs, none, spark):
    out = near_dup.near_duplicates(docs).collect()
    by = {str(r.doc_id): r for r in out}
    assert len(out) == len(TEXTS) and by["1"].component_id == 1 and by["1"].kept and by["1"].n_shingles == 5
    assert (by["2"].n_shingles, by["2"].component_id, by["2"].kept) == (0, 2, True) and by["5"].n_shingles == 0 and by["None"].component_id is None
    assert near_dup.near_duplicates(none).count() == 0
    # a chain: neighbours are linked, its ends are not
    words = [f"w{k}" for k in range(400)]
    rows = [(10 + k, " ".join(words[k * 20: k * 20 + 200])) for k in range(8)] + [(3, "a b c"), (4, "A B  c"), (5, "a b d")]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**{10 + k: 10 for k in range(8)}, 3: 3, 4: 3, 5: 5}


def test_near_dup_of_repeated_ids(spark):
    """Rows of an id are grouped by their own texts; the pipeline keeps one row a group."""
    text = lambda c: " ".join(f"{c}{k}" for k in range(60))
    a, b, c, d = map(text, "abcd")
    rows = [(3, a), (5, a + " x"), (5, b), (9, b + " y"), (5, c), (7, d), (7, d), (7, "\t" + d), (8, d + " z"), (7, a), (3, a + " v"), (3, a + " v")]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, n long").repartition(3)
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(df).collect())
    assert got == sorted([(3, 3, True), (5, 3, False), (5, 5, True), (9, 5, False), (5, 5, True), (7, 7, True), (7, 7, True), (7, 7, True), (8, 7, False), (7, 3, False), (3, 3, True), (3, 3, True)])
    kept = corpus_pipeline.near_dedup(spark, df, "").collect()
    assert sorted((r.doc_id, r.text.split()[0]) for r in kept) == [(3, "a0"), (5, "b0"), (5, "c0"), (7, "d0")] and all(rows[r.n] == (r.doc_id, r.text) for r in kept)


def test_near_dup_family_in_blocks(spark, monkeypatch):
    """A large family whose members differ among each other, in blocks of few."""
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    rng = random.Random(9)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for k in range(90):
        own = list(base)
        for _ in range(rng.choice([0, 1, 2, 3])):
            own[rng.randrange(120)] = f"x{rng.random()}"
        rows.append((k, " ".join(own)))
    sets = {i: {tuple(w[j: j + 5]) for j in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    parent = {i: i for i in sets}

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for a in sets:
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: root(i) for i in sets}


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    for n in (1, 3, 40, 2000):
        both = int(n * 0.6)
        a, b = pool[:n], pool[n - both: 2 * n - both]
        s = near_dup.sketches(np.concatenate([a, b]), np.array([n, n]))
        if n >= 40:
            assert abs((s[0] == s[1]).mean() - both / (2 * n - both)) < 0.2
    assert (near_dup.sketches(np.zeros(0, np.uint64), np.array([0])) == near_dup.sketches(np.zeros(0, np.uint64), np.array([0]))).all()


def test_toxicity(docs, none, spark):
    labels = spark.createDataFrame([(1, None, 1), (1, 0, 0), (2, 0, 1), (3, 1, None), (None, 0, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fitted(docs, labels)
    out = toxicity.score_toxicity(docs, model).collect()
    assert len(out) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert toxicity.score_toxicity(none, model).count() == 0
    empty = toxicity.fitted(none, labels.limit(0))
    assert {r.score for r in toxicity.score_toxicity(docs, empty).collect()} == {0.0}
    assert toxicity.without_toxic(docs, empty).columns == docs.columns


def test_toxicity_sample_passes_over_what_does_not_fit(spark):
    """One long text does not cost the sample the texts behind it, wherever it is."""
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, toxic int")
    usable = [k for k in range(12) if zlib.crc32(str(k).encode()) % toxicity.HELD_OUT]
    for long in usable:
        docs = spark.createDataFrame([(k, "w " * 900 if k == long else f"text {k}") for k in range(12)], "doc_id long, text string")
        texts, y = toxicity.labelled_sample(docs, labels, chars=1000)
        assert sorted(zip(texts, y.tolist())) == sorted((f"text {k}", float(k % 2)) for k in usable if k != long)
    with pytest.raises(ValueError):
        toxicity.labelled_sample(docs, labels, chars=3)


def test_toxicity_sees_the_whole_of_a_run():
    """Text without blanks is cut into words that together hold all its trigrams."""
    for run in ("中文字詞" * 100, "ab" * 40, "x" * 64, "x" * 65, "é" * 33, "y"):
        raw = run.encode()
        words = toxicity.model_words(f"{run} end")
        assert words[-1] == b"end" and all(0 < len(w) <= 64 for w in words)
        assert {raw[k: k + 3] for k in range(len(raw) - 2)} == {w[k: k + 3] for w in words[:-1] for k in range(len(w) - 2)}


def test_gradients_match_differences():
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(2)
    gates, ids = tuple(rng.normal(size=(2, 7, 3 * toxicity.HIDDEN))), rng.integers(0, 7, (5, 4))
    mask = np.arange(5)[:, None] < np.array([5, 3, 1, 4])
    y, w = np.array([1.0, 0, 1, 0]), np.ones(4)
    g, dgates, _ = net.gradients(gates, ids, mask, y, w)
    loss = lambda: net.gradients(gates, ids, mask, y, w)[2]
    for name, at in (("u", (1, 2, 5)), ("a", (3, 1)), ("v", (2,)), ("w", (9,)), ("b", (0,))):
        x, e = net.p[name], 1e-3
        old = x[at]
        x[at] = old + e
        up = loss()
        x[at] = old - e
        down = loss()
        x[at] = old
        assert g[name][at] == pytest.approx((up - down) / (2 * e), abs=2e-4)


def test_frames(docs, none, spark, tmp_path):
    tok, at = Tokenizer.from_file(WORD_BPE), 0
    folder = f"file://{tmp_path}/ids"
    files = frames.write_frames(docs, WORD_BPE, folder, 2, docs_per_file=3)
    assert files.count() > 1
    got = sorted(frames.read_frames(files).collect(), key=lambda r: r.start)
    keys = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys) and len(got) == len(TEXTS)
    for r in got:
        ids = [*tok.encode(next(t for i, t in TEXTS if i == r.doc_id) or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    one = frames.read_frames(files, only=[4], ids=True).collect()
    assert [r.doc_id for r in one] == [4] and len(one[0].ids) == one[0].n_tokens
    assert frames.token_files(none, WORD_BPE, 2).count() == 0
    # a damaged frame is noticed
    path = sorted(f.path for f in pafs.LocalFileSystem().get_file_info(pafs.FileSelector(f"{tmp_path}/ids")))[-1]
    data = bytearray(open(path, "rb").read())
    data[12] ^= 255
    open(path, "wb").write(bytes(data))
    with pafs.LocalFileSystem().open_input_file(path) as f, pytest.raises(Exception):
        reader = frames.FrameReader(f)
        [reader.raw(k) for k in range(len(reader.keys))]


def test_pipeline_stages(docs, none, spark, tmp_path, benchmark):
    for name, df in (("documents", docs), ("labels", spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")), ("benchmark", benchmark)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, str(tmp_path))
        assert stage(spark, none, str(tmp_path)).count() == 0
        if name != "encoding":
            assert out.columns == docs.columns
            kept = spark.createDataFrame(out.collect(), docs.schema)
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert 1 not in ids and {2, 3, 4, 5, 6} <= set(ids)  # 1 is contaminated; wordless rows stay
    assert "ids_sha256" in out.columns and "text" not in out.columns


def test_pipeline_equals_its_stages_by_hand(spark, sf):
    """run()'s rows against plain versions of every stage but the network."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fitted(docs, labels)
    rows = {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    left = {i: t for i, t in rows.items() if model.document_scores([t])[0] < 0.5}
    sets = {i: {tuple(w[k: k + 5]) for k in range(max(1, len(w) - 4))} for i, t in left.items() for w in [t.encode().lower().split()]}
    root = {}
    for i in sorted(sets):
        root[i] = i
        for j in sorted(root):
            if j != i and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    left = {i: t for i, t in left.items() if root[i] == i}
    searcher = decontam.Searcher(decontam.Block.of([tuple(r.values()) for r in pq.read_table(f"{sf}/benchmark.parquet").select(["item_id", "text"]).to_pylist()], 13))
    hits = searcher.search(list(left.values()))
    keep = [i for i, n, runs in zip(left, hits.n_words, hits.runs) if not (runs and 20 * sum(b - a for a, b in runs) >= n)]
    tok, scan = Tokenizer.from_file(WORD_BPE), secret_scan.scanner(secret_scan.BASE + secret_scan.EXTRA).scan
    want = {i: sha(" ".join(map(str, tok.encode(secret_scan.redacted(left[i], scan([left[i]])[0]), add_special_tokens=False).ids))) for i in keep}
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf).collect()} == want
