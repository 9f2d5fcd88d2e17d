"""Personal data: patterns propose spans, checks confirm them, context words score them.

Three steps a kind:

1. a pattern proposes spans, leftmost and non-overlapping. Every proposal is linear in
   the text: addresses are grown outwards from their ``@``, digit groups are joined as
   they are met, the other patterns are of bounded length or cannot back up;
2. a check confirms a proposal or drops it, without a second try: Luhn's sum for card
   numbers, the remainder modulo 97 for account numbers, value ranges for network
   addresses and social security numbers, counts of digits, the characters next to it;
3. the words within ``BEFORE`` characters before and ``AFTER`` behind it move its score,
   in percent: words of the kind lift it, words that name other numbers lower it.

The base kinds (email, ip, card, phone) stay whatever their score. The added ones (iban,
ssn, local_phone, and card_part: a card number inside a longer row of digit groups that
is none) need ``LEAST`` percent. Spans of different kinds may overlap.

Defined results: null and empty texts have no spans; texts are handled whole whatever
their length; repeated rows and rows with null keys each give their own row; spans are
in code points, end exclusive, by start, then kind in the order of ``KINDS``; an empty
table gives no rows; only the key and the text are read, so other columns clash with
nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import forget, map_rows

BASE = ("email", "ip", "card", "phone")
#: Characters of context before and behind a span; the score that added kinds need.
BEFORE, AFTER, LEAST = 40, 20, 50
GAIN, LOSS = 25, 25


@dataclass(frozen=True)
class Kind:
    #: Score of a confirmed span without any context.
    score: int
    #: Context words that lift the score.
    words: tuple[str, ...]


#: The kinds in their order, the scores of confirmed spans and their words.
KINDS = {
    "email": Kind(90, ("mail", "email", "contact", "write", "address")),
    "ip": Kind(60, ("ip", "host", "server", "login", "address")),
    "card": Kind(70, ("card", "visa", "credit", "debit", "payment", "expires")),
    "phone": Kind(70, ("call", "phone", "tel", "mobile", "cell", "fax", "contact")),
    "iban": Kind(80, ("iban", "account", "bank", "transfer", "konto")),
    "ssn": Kind(35, ("ssn", "social", "security", "taxpayer", "tin")),
    "local_phone": Kind(35, ("call", "phone", "tel", "mobile", "cell", "fax", "contact")),
    "card_part": Kind(60, ("card", "visa", "credit", "debit", "payment", "expires")),
}
#: Words before a number that is something else.
OTHERS = ("version", "build", "release", "isbn", "sku", "serial", "part", "order", "invoice", "tracking")

#: Proposals in the order of their kinds; both engines read them alike. Addresses and
#: digit groups are found without these, see :func:`emails` and :func:`cards`.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(\x20?[0-9A-Z]{4}){2,7}(\x20?[0-9A-Z]{1,3})?",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "local_phone": r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}",
    "card_part": r"[0-9]+",
}
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a match from inside a run of digits is one from its start, too
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DIGITS = re.compile("[0-9]+")
_PHONE, _IBAN, _SSN, _LOCAL_PHONE = (re.compile(PATTERNS[k]) for k in ("phone", "iban", "ssn", "local_phone"))
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_DIGIT = frozenset("0123456789")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def context_pattern(words: tuple[str, ...]) -> str:
    """A whole word of ``words`` in lower-cased text."""
    return f"(^|[^a-z])({'|'.join(words)})($|[^a-z])"


_WORDS = {k: re.compile(context_pattern(v.words)) for k, v in KINDS.items()}
_OTHERS = re.compile(context_pattern(OTHERS))


def luhn(digits: str) -> bool:
    """Luhn's sum: every second digit from the right is doubled, nines cast out."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(account: str) -> bool:
    """An account number whose digits, country and check moved to the end and letters
    counted from 10, leave 1 modulo 97."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    floor = 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        a = floor + len(text[floor:at].rstrip(_LOCAL))
        if a < at:
            yield a, m.end()
            floor = m.end()
        else:  # nothing before the sign; the text up to it cannot begin a later match
            floor = at + 1


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            yield m.span()


def cards(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(cards, parts): rows of digit groups one blank or hyphen apart that are card
    numbers, and the groups of longer rows that are card numbers by themselves."""
    whole, parts = [], []
    group: list[tuple[int, int]] = []
    digits, kept = 0, []  # of the row: how many, and the first groups that could be a card together

    def close():
        if 12 <= digits <= 19 and luhn("".join(text[a:b] for a, b in kept)):
            whole.append((group[0][0], group[-1][1]))
        if group and group[0] != group[-1]:
            parts.extend(s for s in candidates if luhn(text[s[0]:s[1]]))

    candidates: list[tuple[int, int]] = []
    for m in _DIGITS.finditer(text):
        a, b = m.span()
        if group and a - group[-1][1] == 1 and text[a - 1] in " -":
            group[1:] = [(a, b)]  # the first and the last are enough
        else:
            close()
            group, digits, kept, candidates = [(a, b)], 0, [], []
        digits += b - a
        if digits <= 19:
            kept.append((a, b))
        if 13 <= b - a <= 19:
            candidates.append((a, b))
    close()
    return whole, parts


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(c in _DIGIT for c in m[0]) <= 15:
            yield m.span()


def alone(text: str, a: int, b: int, of: frozenset) -> bool:
    """No neighbouring character is one of these."""
    return (a == 0 or text[a - 1] not in of) and (b == len(text) or text[b] not in of)


def ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        account = m[0].replace(" ", "")
        if 15 <= len(account) <= 34 and alone(text, *m.span(), _ALNUM) and mod97(account):
            yield m.span()


def ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000" and alone(text, *m.span(), _ALNUM | {"-"}):
            yield m.span()


def local_phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _LOCAL_PHONE.finditer(text):
        a, b = m.span()
        if alone(text, a, b, _ALNUM) and "+" not in text[max(a - 6, 0):a]:
            yield a, b


def score(text: str, kind: str, a: int, b: int) -> int:
    """Percent: the kind's own, moved by the words around the span."""
    before, after = text[max(a - BEFORE, 0):a].translate(_LOWER), text[b:b + AFTER].translate(_LOWER)
    near = bool(_WORDS[kind].search(before) or _WORDS[kind].search(after))
    return min(max(KINDS[kind].score + GAIN * near - LOSS * bool(_OTHERS.search(before)), 0), 100)


def pii_spans(text: str | None) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, score) of one text, by start, then kind."""
    if not text:
        return []
    whole, parts = cards(text)
    proposed = {"email": emails(text) if "@" in text else (), "ip": ips(text), "card": whole, "phone": phones(text) if "+" in text else (),
                "iban": ibans(text), "ssn": ssns(text), "local_phone": local_phones(text), "card_part": parts}
    out = [(a, order, kind, b, s) for order, kind in enumerate(KINDS) for a, b in proposed[kind]
           if (s := score(text, kind, a, b)) >= LEAST or kind in BASE]
    return [(kind, a, b, s) for a, _, kind, b, s in sorted(out)]


def spans_text(spans: list[tuple[str, int, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)


def masked(text: str, spans: list[tuple[str, int, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; of spans that overlap
    the one that begins first stands for the stretch."""
    out, end = [], 0
    for kind, a, b, _ in spans:
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join(out) + text[end:]


def _by_text(df: DataFrame, columns: list[str], schema: str, row: Callable) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        forget()
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            yield row(b, texts, [pii_spans(t) for t in texts])

    return map_rows(df, columns, schema, run)


def find_pii(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key`` and spans, an array of (kind, start, end, score)."""
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.int32())])

    def row(batch, texts, found):
        spans = pa.array([[dict(zip(("kind", "start", "end", "score"), s)) for s in own] for own in found], pa.list_(item))
        return pa.RecordBatch.from_arrays([batch.column(0), spans], [key, "spans"])

    return _by_text(df, [key, text], f"`{key}` {df.schema[key].dataType.simpleString()}, spans array<struct<kind string, start long, end long, score int>>", row)


def pii_digest(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, counts and digest of the base kinds, all spans, their scores."""
    def row(batch, texts, found):
        base = [[s for s in own if s[0] in BASE] for own in found]
        counts = [pa.array([sum(s[0] == k for s in own) for own in base], pa.int64()) for k in BASE]
        digest = pa.array([hashlib.sha256(spans_text(own).encode()).hexdigest() for own in base], pa.string())
        spans, scores = ([f(own) for own in found] for f in (spans_text, lambda own: ",".join(str(s[3]) for s in own)))
        return pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, pa.array(spans, pa.string()), pa.array(scores, pa.string())],
                                          [key, *[f"n_{k}" for k in BASE], "base_sha256", "spans", "scores"])

    counts = ", ".join(f"n_{k} long" for k in BASE)
    return _by_text(df, [key, text], f"`{key}` {df.schema[key].dataType.simpleString()}, {counts}, base_sha256 string, spans string, scores string", row)


def redact_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """Every row and column, personal data in ``text`` replaced by its kind; null texts
    stay null."""
    names = [c for c in df.columns if c != text] + [text]

    def row(batch, texts, found):
        clean = [masked(t, own) if own else t for t, own in zip(texts, found)]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(clean, pa.string())], names)

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
    return _by_text(df, names, schema, row).select(*df.columns)
