"""Secret scans with one combined deterministic automaton.

Every rule is a regular expression over bytes. All of them, each behind "any
bytes", become one automaton by Thompson and subset construction; Moore's
refinement makes it minimal; it is a table of 256 successors a state and a bit
mask of the rules that accept there. A batch of texts is scanned once, by all
rules together, in lanes: texts are cut at bytes that send every state to the
start, and all lanes advance by one byte at a time as one numpy step. Where a
rule's accept bit falls, a match of it ends; the reversed rule's automaton, run
backwards from there, gives the start.

Rules must end in a repeated class (so the longest match is where the bit
falls) and be free of ambiguity in the repeats before it; the rules here are.

Defined results: null and empty texts have no spans. Spans are in code points,
end exclusive, leftmost and non-overlapping for each rule.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _constants as rc
from re import _parser as rp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import forget, map_rows


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: A match counts if this many characters at its end, or of it all, are there.
    least: int
    #: Characters counted: the trailing run of these, or the whole match if empty.
    tail: str = ""


_VALUE = "A-Za-z0-9+/_.=-"
#: The three base rules. Runs of hexadecimal digits are everywhere, so
#: the automaton counts their least length; other rules' short matches are dropped
#: after they have consumed their text.
BASE = (
    Rule("assign", rf"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[{_VALUE}]+", 6, _VALUE),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
#: Added by the method.
EXTRA = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 36),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
)


class Nfa:
    """States with byte-set moves and empty moves."""

    def __init__(self) -> None:
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def closure(self, states: frozenset[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def add(self, items: list, at: int, fold: bool, backwards: bool) -> int:
        """Append the parsed items behind state ``at``; the state behind them."""
        for op, arg in reversed(items) if backwards else items:
            if op in (rc.LITERAL, rc.IN):
                end = self.state()
                self.moves[at].append((byte_set(op, arg, fold), end))
                at = end
            elif op is rc.SUBPATTERN:
                at = self.add(list(arg[3]), at, (fold or bool(arg[1] & 2)) and not arg[2] & 2, backwards)
            elif op is rc.BRANCH:
                end = self.state()
                for branch in arg[1]:
                    start = self.state()
                    self.empty[at].append(start)
                    self.empty[self.add(list(branch), start, fold, backwards)].append(end)
                at = end
            elif op is rc.MAX_REPEAT:
                least, most, inner = arg
                for _ in range(least):
                    at = self.add(list(inner), at, fold, backwards)
                if most is rc.MAXREPEAT:
                    loop = self.state()
                    self.empty[at].append(loop)
                    self.empty[self.add(list(inner), loop, fold, backwards)].append(loop)
                    at = loop
                else:
                    end = self.state()
                    self.empty[at].append(end)
                    for _ in range(most - least):
                        at = self.add(list(inner), at, fold, backwards)
                        self.empty[at].append(end)
                    at = end
            else:
                raise ValueError(f"not supported in a rule: {op}")
        return at


def byte_set(op, arg, fold: bool) -> frozenset[int]:
    out: set[int] = set()
    for kind, x in [(op, arg)] if op is rc.LITERAL else arg:
        if kind is rc.LITERAL:
            out.add(x)
        elif kind is rc.RANGE:
            out.update(range(x[0], x[1] + 1))
        else:
            raise ValueError(f"not supported in a class: {kind}")
    if max(out) > 127:
        raise ValueError("rules are over ASCII")
    if fold:
        out |= {ord(c) for x in list(out) for c in (chr(x).lower(), chr(x).upper())}
    return frozenset(out)


@dataclass
class Dfa:
    #: Successors: state * 256 + byte.
    next: np.ndarray
    #: Bit k: rule k accepts.
    accept: np.ndarray
    start: int

    @functools.cached_property
    def dead(self) -> np.ndarray:
        """States that only reach themselves and accept nothing."""
        table = self.next.reshape(-1, 256)
        return (table == np.arange(len(table))[:, None]).all(1) & (self.accept == 0)

    @functools.cached_property
    def resets(self) -> np.ndarray:
        """Bytes that send every state to the start."""
        return (self.next.reshape(-1, 256) == self.start).all(0)


def compiled(patterns: list[str], anywhere: bool, backwards: bool = False) -> Dfa:
    nfa, root, finals = Nfa(), 0, {}
    nfa.state()
    if anywhere:
        nfa.moves[root].append((frozenset(range(256)), root))
    for k, pattern in enumerate(patterns):
        start = nfa.state()
        nfa.empty[root].append(start)
        finals[nfa.add(list(rp.parse(pattern)), start, False, backwards)] = k
    # bytes that no move tells apart share a class
    sets = list({on for moves in nfa.moves for on, _ in moves})
    classes: dict[tuple[bool, ...], list[int]] = {}
    for byte in range(256):
        classes.setdefault(tuple(byte in on for on in sets), []).append(byte)
    of_byte = np.zeros(256, np.int64)
    for c, members in enumerate(classes.values()):
        of_byte[members] = c
    moves = [[({of_byte[b] for b in on}, t) for on, t in some] for some in nfa.moves]

    first = nfa.closure(frozenset([root]))
    numbers, todo, table, accept = {first: 0}, [first], [], []
    for subset in todo:  # grows while it is read
        row: list[set[int]] = [set() for _ in classes]
        for s in subset:
            for on, t in moves[s]:
                for c in on:
                    row[c].add(t)
        cells = []
        for targets in row:
            closed = nfa.closure(frozenset(targets))
            if closed not in numbers:
                numbers[closed] = len(numbers)
                todo.append(closed)
            cells.append(numbers[closed])
        table.append(cells)
        accept.append(sum(1 << k for f, k in finals.items() if f in subset))
    return minimal(np.array(table, np.int64), np.array(accept, np.int64), of_byte)


def minimal(table: np.ndarray, accept: np.ndarray, of_byte: np.ndarray) -> Dfa:
    """Moore's refinement: split states until equal classes have equal successors."""
    block = np.unique(accept, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    first = np.unique(block, return_index=True)[1]
    return Dfa(block[table[first]][:, of_byte].astype(np.int32).reshape(-1), accept[first], int(block[0]))


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        self.forward = compiled([r.pattern for r in rules], anywhere=True)
        self.backward = [compiled([r.pattern], anywhere=False, backwards=True) for r in rules]
        self._tail = [np.isin(np.arange(256), list(byte_set(rc.IN, rp.parse(f"[{r.tail}]")[0][1], False))) if r.tail else None for r in rules]

    def ends(self, buffer: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end, rules whose accept bit falls there) over all lanes, unordered."""
        table, accept = self.forward.next, self.forward.accept
        order = np.argsort(starts - stops, kind="stable")
        at, length = starts[order], (stops - starts)[order]
        state = np.full(len(at), self.forward.start, np.int32)
        bits = np.zeros(len(at), accept.dtype)
        found_at, found = [], []
        live = len(at)
        for step in range(int(length[0]) if len(length) else 0):
            if length[live - 1] <= step:
                still = int(np.searchsorted(-length, -step, "left"))
                if (gone := np.flatnonzero(bits[still:live])).size:
                    found_at.append(at[still:live][gone] + length[still:live][gone])
                    found.append(bits[still:live][gone])
                live = still
                state, bits = state[:live], bits[:live]
            state = table[(state << 8) | buffer[at[:live] + step]]
            now = accept[state]
            if (fell := np.flatnonzero(bits & ~now)).size:
                found_at.append(at[fell] + step)
                found.append((bits & ~now)[fell])
            bits = now
        if (gone := np.flatnonzero(bits)).size:
            found_at.append(at[:live][gone] + length[:live][gone])
            found.append(bits[gone])
        return (np.concatenate(found_at), np.concatenate(found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def start(self, rule: int, data: bytes, end: int, floor: int) -> int:
        """The leftmost start, not before ``floor``, of a match that ends there; -1: none."""
        dfa, state, best = self.backward[rule], self.backward[rule].start, -1
        dead = dfa.dead
        for i in range(end - 1, floor - 1, -1):
            state = int(dfa.next[(state << 8) | data[i]])
            if dead[state]:
                break
            if dfa.accept[state]:
                best = i
        return best

    def scan(self, texts: list[str | None], lane: int = 1024) -> list[list[tuple[int, int, int]]]:
        """For each text its spans (rule, start, end) by start, then rule."""
        data = [t.encode() if t else b"" for t in texts]
        lengths = np.array([len(d) for d in data], np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if not offsets[-1]:
            return out
        buffer = np.frombuffer(b"".join(data), np.uint8)
        # lanes: every text's start, and the byte behind the first reset in every stretch of `lane` bytes
        resets = np.flatnonzero(self.forward.resets[buffer]) + 1
        probe = np.arange(lane, len(buffer), lane)
        spot = np.searchsorted(resets, probe)
        cuts = np.unique(np.concatenate([offsets[:-1], resets[spot[spot < len(resets)]]]))
        cuts = cuts[cuts < len(buffer)]
        ends, bits = self.ends(buffer, cuts, np.append(cuts[1:], len(buffer)))
        order = np.argsort(ends, kind="stable")
        last: dict[tuple[int, int], int] = {}
        for end, mask in zip(ends[order].tolist(), bits[order].tolist()):
            doc = int(np.searchsorted(offsets, end - 1, "right")) - 1
            own, end = data[doc], end - int(offsets[doc])
            for k, rule in enumerate(self.rules):
                if not mask >> k & 1:
                    continue
                begin = self.start(k, own, end, last.get((doc, k), 0))
                if begin < 0:
                    continue
                last[doc, k] = end
                counted = end - begin
                if rule.tail:
                    counted = next((n for n in range(end - begin) if not self._tail[k][own[end - 1 - n]]), end - begin)
                    counted = self.value_length(own[begin:end], counted)
                if counted >= rule.least:
                    out[doc].append((k, begin, end))
        for doc, spans in enumerate(out):
            if spans and not texts[doc].isascii():
                points = functools.lru_cache(None)(lambda i, d=data[doc]: len(d[:i].decode()))
                spans[:] = [(k, points(a), points(b)) for k, a, b in spans]
            spans.sort(key=lambda s: (s[1], s[0]))
        return out

    @staticmethod
    def value_length(match: bytes, counted: int) -> int:
        """The value of an assignment starts behind its separator, which the value
        class may hold too."""
        keyword = next(i for i in range(len(match)) if match[i] in b":=")
        value = match[keyword + 1:].lstrip(b" ")
        return min(counted, len(value) - (value[:1] in (b'"', b"'")))


@functools.cache
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def spans_text(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every maximal covered stretch replaced by ``mark``."""
    out, at = [], 0
    end = 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= end:
            out.append(text[at:a] + mark)
        at = end = max(end, b)
    return "".join(out) + text[at:]


def _by_text(df: DataFrame, columns: list[str], schema: str, rules: tuple[Rule, ...], row: Callable) -> DataFrame:
    scan = scanner(rules).scan  # compiled once, on the driver; the table's size is fixed by the rules

    def run(batches: Iterator[pa.RecordBatch]):
        forget()
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                texts = part.column("text").to_pylist()
                yield row(part, texts, scan(texts))

    return map_rows(df, columns, schema, run)


def scan_secrets(df: DataFrame, rules: tuple[Rule, ...] = BASE + EXTRA, key: str = "doc_id") -> DataFrame:
    """Per document: counts and digest of the base rules, and all spans."""
    def row(part, texts, found):
        base = [[s for s in spans if s[0] < len(BASE)] for spans in found]
        counts = [pa.array([sum(s[0] == k for s in spans) for spans in base], pa.int64()) for k in range(len(BASE))]
        digests = [hashlib.sha256(spans_text(spans, rules).encode()).hexdigest() for spans in base]
        return pa.RecordBatch.from_arrays([part.column(key), *counts, pa.array(digests, pa.string()), pa.array([spans_text(s, rules) for s in found], pa.string())],
                                          [key, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = df.schema[key].dataType.simpleString()
    return _by_text(df, [key, "text"], f"{key} {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", rules, row)


def redact_secrets(df: DataFrame, rules: tuple[Rule, ...] = BASE + EXTRA) -> DataFrame:
    """Every row, with its secrets replaced in ``text``; null texts stay null."""
    names = df.columns

    def row(part, texts, found):
        clean = [redacted(t, s) if s else t for t, s in zip(texts, found)]
        return pa.RecordBatch.from_arrays([pa.array(clean, pa.string()) if c == "text" else part.column(c) for c in names], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return _by_text(df, names, schema, rules, row)
