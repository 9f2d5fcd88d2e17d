"""Personal data: against the plain patterns, the SQL on made-up cases, and edge cases."""

import random
import re

import duckdb
import pandas as pd
import pytest

from txnlens.llm import pii
from txnlens.llm.oracles import personal_data
from txnlens.llm.queries import QUERIES

PARTS = ["1", "2", "0", "9", "@", "a.", "b@c.d", "-", " ", ".", "+", "4111111111111111", "25", "12", ".3", "(", ")", "x", "é", "4111 1111 1111 1111", "\n",
         "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "123-45-6789", " 555-123-4567", " call ", " card ", " SSN: ", " Version ", "10.0.0.1"]


def plain(text):
    out = []
    for order, kind in enumerate(pii.BASE):
        for m in re.finditer(pii.PATTERNS[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                  "card": lambda: 12 <= len(digits) <= 19 and sum(sum(map(int, str(int(d) * (1 + k % 2)))) for k, d in enumerate(digits[::-1])) % 10 == 0,
                  "phone": lambda: 9 <= len(digits) <= 15}[kind]()
            if ok:
                out.append((m.start(), order, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def made_up(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_base_spans_are_those_of_the_patterns():
    found = 0
    for text in made_up(20_000):
        own = [s[:3] for s in pii.pii_spans(text) if s[0] in pii.BASE]
        assert own == plain(text), text
        found += len(own)
    assert found > 10_000


def test_sql_on_made_up_texts(spark):
    rows = list(enumerate(made_up(1500, 5))) + [(7, None), (None, "a@b.c"), (7, "call 555-123-4567"), (7, "call 555-123-4567")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(str(tuple(r)) for r in pii.pii_digest(docs).collect())
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    columns = ", ".join(pii.pii_digest(docs).columns)
    want = sorted(str(r) for r in con.execute(f"SELECT {columns} FROM ({personal_data()})").fetchall())
    assert got == want
    kinds = {s.split(":")[0] for r in got for s in re.findall(r"[a-z_]+:\d+:\d+", r)}
    assert kinds == set(pii.KINDS)


@pytest.mark.parametrize("text, want", [
    ("mail ada@example.org.", [("email", 5, 20, 100)]),
    ("é 4111 1111 1111 1111", [("card", 2, 21, 70)]),
    ("4111111111111111 4012888888881881", [("card_part", 0, 16, 60), ("card_part", 17, 33, 60)]),
    ("4111111111111112", []),
    ("IBAN GB82 WEST 1234 5698 7654 32", [("iban", 5, 32, 100)]),
    ("IBAN GB82 WEST 1234 5698 7654 33", []),
    ("123-45-6789", []),
    ("my SSN is 123-45-6789", [("ssn", 10, 21, 60)]),
    ("my SSN is 666-45-6789", []),
    ("version 1.2.3.4", [("ip", 8, 15, 35)]),
    ("call 555-123-4567", [("local_phone", 5, 17, 60)]),
    ("order 555-123-4567, call", []),
    ("+1 (017) 555-7713", [("phone", 0, 17, 70)]),
])
def test_checks_and_context(text, want):
    assert pii.pii_spans(text) == want


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    out = {r.doc_id: r for r in QUERIES["op11_pii"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(out) == len(docs)
    for d in docs:
        want = plain(d.text)
        assert [out[d.doc_id][f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in want) for k in pii.BASE]


@pytest.mark.parametrize("unit", ["a", "1", "1 ", "a@", "+1", "A1", "12-", "AB12 ", "@a."])
def test_long_texts_take_linear_time(unit):
    text = unit * (1_000_000 // len(unit)) + " x@y.z"
    assert pii.pii_spans(text)[-1][:3] in {("email", len(text) - 5, len(text), 0)[:3]}


def test_edges(spark):
    rows = [(1, None, "en", 1), (1, "", "en", 1), (None, "a@b.c", None, 2), (2, "a@b.c", None, 2), (2, "a@b.c", None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, start int")
    assert sorted(str(tuple(r)) for r in pii.find_pii(docs).select("doc_id", "spans.kind", "spans.start").collect()) == [
        "(1, [], [])", "(1, [], [])", "(2, ['email'], [0])", "(2, ['email'], [0])", "(None, ['email'], [0])"]
    clean = pii.redact_pii(docs)
    assert clean.columns == docs.columns
    assert sorted(str(r.text) for r in clean.collect()) == ["", "None", "[EMAIL]", "[EMAIL]", "[EMAIL]"]
    for f in (pii.find_pii, pii.pii_digest, pii.redact_pii):
        assert f(docs.limit(0)).count() == 0


def test_masks_overlapping_spans_once():
    text = "a@1.2.3.4"
    spans = pii.pii_spans(text)
    assert [s[0] for s in spans] == ["email", "ip"]
    assert pii.masked(f"{text} b", spans) == "[EMAIL] b"
