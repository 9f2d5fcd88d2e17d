"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

Encoding never holds a whole word: symbols enter one by one, and for every
position the one token is kept that ends the encoding of the text up to there.
That token is found without rerunning the merges: a token ``t`` ends the
encoding at ``i`` exactly if ``t`` spells the symbols before ``i`` and the pair
(token ending where ``t`` starts, ``t``) encodes to itself. A token boundary is
stable once the chains of all positions within one token length of the end pass
through it; the merge list bounds how far behind the end that can be
(``sufficient_lookahead``), so the buffer is constant whatever the text's
length. Decoding goes the other way through a byte state machine.

Defined results: null and empty texts have no tokens; special strings of the
vocabulary file that occur in a text become their special ids, as the file says.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import held, map_rows, named, with_text

#: Characters of a text that are handled at once.
PIECE_CHARS = 1 << 16
#: Entries of each memo; a full one is emptied.
CHUNK_MEMO, WORD_MEMO, PAIR_MEMO = 500_000, 300_000, 300_000
#: str.split() and \s separate at these too, the vocabularies' patterns do not.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
_SPACES = re.compile(r"[^\S\x1c-\x1f]+")
_CUT = re.compile(r"(?<=[\S\x1c-\x1f])[^\S\x1c-\x1f]")
_LED = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Merges:
    """A merge list compiled for streaming. ``suffix`` marks a word's last symbol.

    The tokens that end at a position come from an Aho-Corasick automaton over the
    vocabulary, the longest first. Whether two tokens stay apart is read off their
    merge trees: at any rank of the list only the last piece of the left token and the
    first piece of the right one touch, and the pair is undone exactly if a merge of two
    such pieces comes before either of them is merged into its own token. (Of equal
    ranks the leftmost place goes first.) This needs merges whose parts are made by
    earlier ones, as trained lists are; for others the merges are run."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = "") -> None:
        self.vocab, self.suffix = vocab, suffix
        self.ranks = {pair: k for k, pair in reversed(list(enumerate(merges)))}
        plain = len(suffix)
        self.symbols: dict[str, int] = {}
        for token in vocab:
            self.symbols[token] = len(token) - plain if suffix and token.endswith(suffix) and len(token) > plain else len(token)
        self.longest = max(self.symbols.values(), default=1)
        self.lookahead = self.sufficient_lookahead(merges)
        made = {}
        for (x, y), k in self.ranks.items():
            made[x + y] = min(made.get(x + y, k), k)
        self.rising = all(made.get(x, -1) < k and made.get(y, -1) < k for (x, y), k in self.ranks.items())
        #: Tokens by number, which pairs of them fit (number * count + number), each one's end pieces.
        self.names = list(vocab)
        self.ids = list(vocab.values())
        self.sizes = [self.symbols[t] for t in self.names]
        self._pairs: dict[int, bool] = {}
        self._edges: dict[int, tuple[list, list] | None] = {}
        self.automaton = ahocorasick.Automaton()
        #: Numbers of the tokens that can end a word, by what they spell.
        self.final: dict[str, int] = {}
        for k, token in enumerate(self.names):
            if token:
                self.automaton.add_word(token, (len(token), k))
                if not suffix or self.symbols[token] < len(token):
                    self.final[token[: self.symbols[token]]] = k
        if len(self.automaton):
            self.automaton.make_automaton()

    def sufficient_lookahead(self, merges: list[tuple[str, str]]) -> int:
        """Symbols after a boundary that can still undo it: the longest chain of
        merges (x, y), (y, z), ... of falling rank, each of which takes the left
        part that the one before it needs, plus one token for the last of them."""
        reach: dict[str, int] = {}
        for x, y in merges:
            far = self.symbols.get(y, len(y)) + reach.get(y, 0)
            if far > reach.get(x, 0):
                reach[x] = far
        return max(reach.values(), default=0) + self.longest

    def spelled(self, token: str) -> list[str]:
        n = self.symbols[token]
        return [*token[: n - 1], token[n - 1:]]

    def merged(self, symbols: list[str], ends: tuple[list, list] | None = None) -> list[str]:
        """The merges in rank order, leftmost first: the plain definition. ``ends``
        takes, for the first and for the last piece, each piece with the rank that ends it."""
        ranks = self.ranks
        while len(symbols) > 1:
            near = [ranks.get(pair, 1 << 60) for pair in zip(symbols, symbols[1:])]
            rank = min(near)
            if rank == 1 << 60:
                break
            best = near.index(rank)
            if ends and best == 0:
                ends[0].append((symbols[0], rank))
            if ends and best == len(symbols) - 2:
                ends[1].append((symbols[-1], rank))
            symbols[best: best + 2] = [symbols[best] + symbols[best + 1]]
        return symbols

    def edges(self, k: int) -> tuple[list, list] | None:
        """The token's first and last pieces with the ranks that end them, from single
        symbols to the token itself; None if its own symbols do not merge to it. Kept: at
        most one entry a token of the vocabulary."""
        if k not in self._edges:
            token, ends = self.names[k], ([], [])
            whole = self.merged(self.spelled(token), ends) == [token]
            for side in ends:
                side.append((token, 1 << 60))
            self._edges[k] = ends if whole else None
        return self._edges[k]

    def fits(self, left: int, right: int) -> bool:
        """Whether the pair of tokens, by number, encodes to itself."""
        if len(self._pairs) >= PAIR_MEMO:
            self._pairs.clear()
        names = self.names[left], self.names[right]
        own = self._apart(left, right) if self.rising else self.merged(self.spelled(names[0]) + self.spelled(names[1])) == [*names]
        self._pairs[left * len(self.names) + right] = own
        return own

    def _apart(self, left: int, right: int) -> bool:
        a, b = self.edges(left), self.edges(right)
        if a is None or b is None:
            return False
        last, first, i, j, ranks = a[1], b[0], 0, 0, self.ranks
        while True:
            (x, until_x), (y, until_y) = last[i], first[j]
            rank = ranks.get((x, y))
            if rank is not None and rank < until_x and rank <= until_y:
                return False
            if until_x == until_y == 1 << 60:
                return True
            if until_x <= until_y:
                i += 1
            else:
                j += 1

    def stream(self, symbols: str | Iterable[str]) -> Iterable[int]:
        """Ids of one word, each as soon as it is stable. ``symbols`` are the word's
        characters; the last is marked here. A longer word is read in blocks of the
        longest token's length, and only what is not stable yet is held."""
        if isinstance(symbols, str) and len(symbols) <= self.lookahead + self.longest:
            last, n = [-1] * (len(symbols) + 1), len(symbols)
            if n > bool(self.suffix):
                self._fill(self.automaton.iter(symbols, 0, n - bool(self.suffix)), last, 0)
            return self._ids(self._ended(last, symbols), n)
        return self._streamed(iter(symbols))

    def _streamed(self, symbols: Iterator[str]) -> Iterator[int]:
        read = lambda: "".join(islice(symbols, self.longest))
        block, after, found = read(), read(), None
        last, gone, tail = [-1], 0, ""
        while block:
            last += [-1] * len(block)
            own = block if after or not self.suffix else block[:-1]
            if own:
                if found is None:
                    found = self.automaton.iter(own)
                else:
                    found.set(own)
                self._fill(found, last, gone)
            tail = (tail + block)[-self.longest:]
            if after and len(last) > self.lookahead + self.longest and (cut := self._stable(last)):
                yield from self._ids(last, cut)
                last, gone = last[cut:], gone + cut
            block, after = after, read()
        yield from self._ids(self._ended(last, tail), len(last) - 1)

    def _fill(self, found: Iterable[tuple[int, tuple[int, int]]], last: list[int], gone: int) -> None:
        """Sets the token that ends at each position of the buffer ``last`` (-1: none),
        in front of which ``gone`` symbols have left. ``found`` has the tokens that end
        at each position, the longest first."""
        known, fits, seen, edges, count = self._pairs.get, self.fits, self._edges.get, self.edges, len(self.names)
        for k, (size, token) in found:
            at = k + 1 - gone
            if last[at] >= 0 or size > at:
                continue  # a longer token ends here, or this one begins before the buffer
            before = last[at - size]
            if before < 0:
                if seen(token) or edges(token):  # its own symbols merge to it
                    last[at] = token
            elif (fit := known(before * count + token)) or (fit is None and fits(before, token)):
                last[at] = token

    def _ended(self, last: list[int], tail: str) -> list[int]:
        """Sets the token that ends the word; ``tail`` is the end of its symbols."""
        n = len(last) - 1
        if self.suffix and n:
            for size in range(min(self.longest, n), 0, -1):
                token, before = self.final.get(tail[len(tail) - size:]), last[n - size]
                if token is not None and (self.edges(token) if before < 0 else self._pairs.get(before * len(self.names) + token) or self.fits(before, token)):
                    last[n] = token
                    break
        return last

    def _stable(self, last: list[int]) -> int:
        """The last boundary that the chains of all positions near the end share."""
        chains, n = [], len(last) - 1
        for end in range(max(1, n + 1 - self.longest), n + 1):
            at, cuts = end, set()
            while at > 0:
                at -= self.sizes[last[at]] if last[at] >= 0 else 1
                cuts.add(at)
            chains.append(cuts)
        return max(set.intersection(*chains), default=0)

    def _ids(self, last: list[int], end: int) -> list[int]:
        """The tokens of the chain that ends there. After a cut the first entry is the
        token before the boundary, as later tokens must fit it; it is not of the chain."""
        out, ids, sizes = [], self.ids, self.sizes
        while end > 0:
            token = last[end]
            if token >= 0:
                out.append(ids[token])
                end -= sizes[token]
            else:  # a symbol that no token spells is left out, as the library does
                end -= 1
        out.reverse()
        return out


class StreamEncoder:
    """A tokenizer file's encoding: its own normaliser and word pattern (through
    the library for words beyond ASCII), and the streaming merges."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.tokenizer = Tokenizer.from_file(path)
        #: The word pattern drops white space; otherwise a word may start with it.
        self.drops = not any(w[:1] in (" ", "Ġ") for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str("a b"))
        self.merges = Merges(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model.get("end_of_word_suffix") or "")
        self.special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self._special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # the file's own word pattern, for runs on which its normaliser only lowers case
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        self._pattern = regex.compile(split["pattern"]["Regex"]) if steps == ["NFC", "Replace", "Lowercase"] and split.get("type") == "Split" and split.get("invert") else None
        self._odd = re.compile("[\u0130\u0250-\U0010FFFF]")
        self._letters = dict(enumerate(byte_alphabet()))
        self._words: dict[str, tuple[int, ...]] = {}
        self._chunks: dict[str, tuple[int, ...]] = {}
        self.tokens = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token in the byte alphabet."""
        if (ids := self._words.get(word)) is None:
            ids = tuple(self.merges.stream(word))
            if len(word) <= 64:
                if len(self._words) >= WORD_MEMO:
                    self._words.clear()
                self._words[word] = ids
        return ids

    def chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of a run that ends where white space begins. No word of the pattern goes
        on into white space behind it, and no canonical composition does, so runs
        are independent."""
        if self._pattern and not self._odd.search(chunk):
            letters = self._letters
            # printable ASCII stands for itself
            parts = [w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(letters) for w in self._pattern.findall(chunk.lower())]
        else:
            tokenizer = self.tokenizer
            parts = [w for w, _ in tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(chunk) if tokenizer.normalizer else chunk)]
        ids = self.word(parts[0]) if len(parts) == 1 else tuple(chain.from_iterable(map(self.word, parts)))
        if len(chunk) <= 64:
            if len(self._chunks) >= CHUNK_MEMO:
                self._chunks.clear()
            self._chunks[chunk] = ids
        return ids

    def pieces(self, text: str) -> Iterator[str]:
        """Cut where white space begins, about every PIECE_CHARS characters."""
        at = 0
        while len(text) - at > PIECE_CHARS:
            space = _CUT.search(text, at + PIECE_CHARS)
            if not space:
                break
            yield text[at: space.start()]
            at = space.start()
        yield text[at:] if at else text

    def stream(self, text: str | None) -> Iterator[list[int]]:
        """Lists of ids, piece by piece."""
        known = self._chunks.get
        for part in (self._special_split.split(text) if text and self._special_split and any(s in text for s in self.special) else [text or ""]):
            if part in self.special:
                yield [self.special[part]]
                continue
            for piece in self.pieces(part):
                runs = _LED.findall(piece) if not self.drops else [r for r in _SPACES.split(piece) if r] if _NOT_SPACE.search(piece) else piece.split()
                ids: list[int] = []
                for run in runs:
                    ids += known(run) or self.chunk(run)
                if ids:
                    yield ids

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.stream(text)))


class StreamDecoder:
    """Ids to text, piece by piece. With ``joined`` (files without a decoder) the
    text is the tokens joined by spaces; otherwise each token's characters turn
    back into bytes and an incremental UTF-8 state machine emits whole
    characters, holding back at most three bytes."""

    def __init__(self, tokens: dict[int, str], joined: bool) -> None:
        self.joined = joined
        self.first = True
        self._utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        if joined:
            self.table: dict = tokens
        else:
            to_byte = {c: b for b, c in enumerate(byte_alphabet())}
            self.table = {i: bytes(to_byte[c] for c in t) if all(c in to_byte for c in t) else t.encode() for i, t in tokens.items()}

    def feed(self, ids: list[int]) -> str:
        if not ids:
            return ""
        if self.joined:
            text = " ".join([self.table[i] for i in ids])
            lead, self.first = "" if self.first else " ", False
            return lead + text
        return self._utf8.decode(b"".join([self.table[i] for i in ids]))

    def end(self) -> str:
        """What is left when the ids end; the decoder can then be used again."""
        self.first = True
        text = "" if self.joined else self._utf8.decode(b"", True)
        self._utf8.reset()
        return text


def encoder(path: str) -> StreamEncoder:
    """One per Python worker and file."""
    return held(("bpe", path), lambda: StreamEncoder(path))


def bpe_encode(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column``, ``ids`` array<int> of every row's whole text. Null: no ids."""
    def run(batches):
        enc = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.encode(t.as_py()) for t in b.column(1)], pa.list_(pa.int32()))], [id_column, "ids"])

    kind = df.schema[id_column].dataType.simpleString()
    return map_rows(df, [id_column, text_column], f"{id_column} {kind}, ids array<int>", run)


def bpe_decode(df: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """``id_column``, ``text`` decoded from ``ids``; null ids: empty text."""
    def run(batches):
        enc = encoder(path)
        dec = StreamDecoder(enc.tokens, enc.tokenizer.decoder is None)
        for b in batches:
            texts = [dec.feed(ids.as_py() or []) + dec.end() for ids in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [id_column, "text"])

    kind = df.schema[id_column].dataType.simpleString()
    return map_rows(df, [id_column, "ids"], f"{id_column} {kind}, text string", run)


def bpe_digest(df: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text_column: str = "text") -> DataFrame:
    """Per row: the ``keep`` columns, n_tokens, ids_sha256 (decimal ids joined by
    a space) and decoded_sha256 (UTF-8 of the decoded ids). Texts are encoded,
    decoded and hashed piece by piece; nothing grows with a text."""
    def run(batches):
        enc = encoder(path)
        dec = StreamDecoder(enc.tokens, enc.tokenizer.decoder is None)
        decimal = {i: str(i) for i in enc.tokens}
        for b in batches:
            counts, ids_hex, text_hex = [], [], []
            for text in b.column(len(keep)).to_pylist():
                of_ids, of_text, n = hashlib.sha256(), hashlib.sha256(), 0
                for ids in enc.stream(text):
                    if n:
                        of_ids.update(b" ")
                    of_ids.update(" ".join([decimal[i] for i in ids]).encode())
                    of_text.update(dec.feed(ids).encode())
                    n += len(ids)
                of_text.update(dec.end().encode())
                counts.append(n)
                ids_hex.append(of_ids.hexdigest())
                text_hex.append(of_text.hexdigest())
            out = [b.column(k) for k in range(len(keep))] + [pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())]
            yield pa.RecordBatch.from_arrays(out, [*b.schema.names[: len(keep)], "n_tokens", "ids_sha256", "decoded_sha256"])

    return named(with_text(df, keep, text_column, "n_tokens long, ids_sha256 string, decoded_sha256 string", run), keep)
