"""Chat formatting by token-level assembly.

Every turn is a segment of its own: the control strings in its text are escaped,
the text is encoded alone with special strings switched off, and reserved ids
beyond the vocabulary are spliced around it. So no text can produce a reserved
id, and the rendered string can hold no control string that the template did not
put there. A conversation is its turns' segments in order; positions and the loss
mask come from prefix sums of the segments' lengths. Turns are read back from the
ids and the mask alone.

Template (no blanks are added):

    system     <<SYS>> text <</SYS>>
    user       [INST] text [/INST]
    assistant  <s> text </s>
    any other  [ROLE] role [/ROLE] text </s>

Escaping: a backslash is doubled, and a control string gets a backslash after its
first character; a backslash always stands for the character behind it.

The loss is on assistant texts. Conversations are dealt out by id and sorted by
turn; a task streams through them with constant memory, so a conversation of any
length does.

Defined results: a null text or role is empty; turns are ordered by turn (null
first), equal turns by role and text; a null conv_id is a conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import StreamDecoder
from .common import held, in_batches, steps

#: Control strings; their reserved ids follow the vocabulary in this order.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
OPEN_TEXT, END_TEXT, OPEN_USER, END_USER, OPEN_SYS, END_SYS, OPEN_ROLE, END_ROLE = range(len(CONTROLS))
FRAMES = {"system": (OPEN_SYS, END_SYS), "user": (OPEN_USER, END_USER), "assistant": (OPEN_TEXT, END_TEXT)}
ROLES = {first: role for role, (first, _) in FRAMES.items()}
LOSS_ROLE = "assistant"
_CONTROL = re.compile("|".join(map(re.escape, (*sorted(CONTROLS, key=len, reverse=True), "\\"))))
STEP_CHARS = 4 << 20


def escaped(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


class Template:
    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.base = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.decoder = StreamDecoder({i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}, False)

    def segments(self, roles: list[str], texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """For each turn (lengths of its segments, its ids): control, text, control,
        and for other roles two more before them."""
        named = [r if r not in FRAMES else "" for r in roles]
        encoded = [e.ids for e in self.tokenizer.encode_batch([escaped(t) for t in (*texts, *named)], add_special_tokens=False)]
        out = []
        for role, ids, name in zip(roles, encoded, encoded[len(texts):]):
            if role in FRAMES:
                first, last = FRAMES[role]
                out.append(([1, len(ids), 1], [self.base + first, *ids, self.base + last]))
            else:
                out.append(([1, len(name), 1, len(ids), 1], [self.base + OPEN_ROLE, *name, self.base + END_ROLE, *ids, self.base + END_TEXT]))
        return out

    def decode(self, ids: list[int]) -> str:
        return self.decoder.feed(ids) + self.decoder.end()

    def rendered(self, ids: list[int]) -> str:
        """The formatted string of a stretch of ids."""
        out, at = [], 0
        for k in [k for k, i in enumerate(ids) if i >= self.base] + [len(ids)]:
            out.append(self.decode(ids[at:k]))
            if k < len(ids):
                out.append(CONTROLS[ids[k] - self.base])
            at = k + 1
        return "".join(out)

    def turns(self, ids: list[int]) -> Iterator[tuple[str, str]]:
        """(role, text) read back from whole turns' ids."""
        role, at = None, 0
        for k in [k for k, i in enumerate(ids) if i >= self.base]:
            control = ids[k] - self.base
            if control in ROLES and role is None:
                role, at = ROLES[control], k + 1
            elif control == OPEN_ROLE:
                at = k + 1
            elif control == END_ROLE:
                role, at = unescaped(self.decode(ids[at:k])), k + 1
            else:
                yield role, unescaped(self.decode(ids[at:k]))
                role = None


def template(path: str) -> Template:
    return held(("chat", path), lambda: Template(path))


def masks(lengths: list[list[int]], in_loss: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all segments, and the mask over all ids: the prefix sum of +1 where
    a text under loss starts and -1 where it ends."""
    flat = np.array([n for turn in lengths for n in turn], np.int64)
    ends = np.cumsum(flat)
    starts = ends - flat
    text = np.cumsum([len(turn) for turn in lengths]) - 2  # each turn's text is its last segment but one
    chosen = text[np.array(in_loss, bool)] if len(text) else np.zeros(0, np.int64)
    delta = np.zeros(int(flat.sum()) + 1, np.int64)
    np.add.at(delta, starts[chosen], 1)
    np.add.at(delta, ends[chosen], -1)
    return starts, np.cumsum(delta)[:-1] > 0


def format_turns(df: DataFrame, path: str) -> DataFrame:
    """Per turn: conv_id, turn, role, text (both null-free), ids and the offsets of
    the text under loss (loss_from = loss_to where there is none) within the turn."""
    def run(batches: Iterator[pa.RecordBatch]):
        make = template(path)
        for whole in batches:
            for b in steps(whole, 3, STEP_CHARS):
                roles, texts = b.column(2).to_pylist(), b.column(3).to_pylist()
                made = make.segments(roles, texts)
                ids, start, stop = [], [], []
                for role, (lengths, own) in zip(roles, made):
                    _, mask = masks([lengths], [role == LOSS_ROLE])
                    under = np.flatnonzero(mask)
                    start.append(int(under[0]) if under.size else 0)
                    stop.append(int(under[-1]) + 1 if under.size else 0)
                    ids.append(own)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(ids, pa.list_(pa.int32())), pa.array(start, pa.int32()), pa.array(stop, pa.int32())],
                                                 ["conv_id", "turn", "role", "text", "ids", "loss_from", "loss_to"])

    rows = df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return in_batches(rows).mapInArrow(run, "conv_id long, turn long, role string, text string, ids array<int>, loss_from int, loss_to int")


def in_order(turns: DataFrame) -> DataFrame:
    """Whole conversations in one partition each, in order."""
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")


def assembled(df: DataFrame, path: str) -> DataFrame:
    """Per turn, with its place in its conversation: start, the running sum of
    lengths, and the loss mask's stretch as positions of the conversation."""
    def run(batches: Iterator[pa.RecordBatch]):
        current, at = object(), 0
        for b in batches:
            conv, sizes = b.column(0).to_pylist(), pa.compute.list_value_length(b.column(2)).to_pylist()
            starts = []
            for c, n in zip(conv, sizes):
                if c != current:
                    current, at = c, 0
                starts.append(at)
                at += n
            where = np.array(starts, np.int64)
            loss = [pa.array(np.where(b.column(4).to_numpy() > b.column(3).to_numpy(), where + b.column(k).to_numpy(), 0)) for k in (3, 4)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(where), b.column(2), *loss], ["conv_id", "turn", "start", "ids", "loss_from", "loss_to"])

    return in_order(format_turns(df, path)).select("conv_id", "turn", "ids", "loss_from", "loss_to").mapInArrow(
        run, "conv_id long, turn long, start long, ids array<int>, loss_from long, loss_to long")


def read_back(turns: DataFrame, path: str) -> DataFrame:
    """Per conversation, from ids and mask alone: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars. ``turns``: what ``assembled`` gives,
    in its order; hashes run on from turn to turn."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]):
        make = template(path)
        state = None

        def row():
            return [[state["id"]], [state["turns"]], [state["all"].hexdigest()], [state["loss"]], [state["under"].hexdigest()], [state["chars"]]]

        done: list[list] = []
        for b in batches:
            for r in b.to_pylist():
                if state is None or r["conv_id"] != state["id"]:
                    if state is not None:
                        done.append(row())
                    state = {"id": r["conv_id"], "turns": 0, "all": hashlib.sha256(), "loss": 0, "under": hashlib.sha256(), "chars": 0}
                for role, text in make.turns(r["ids"]):
                    state["turns"] += 1
                    state["all"].update(f"{role}\n{text}\n".encode())
                if r["loss_to"] > r["loss_from"]:
                    under = unescaped(make.decode(r["ids"][r["loss_from"] - r["start"]: r["loss_to"] - r["start"]]))
                    state["loss"] += len(under)
                    state["under"].update(under.encode())
                state["chars"] += len(make.rendered(r["ids"]))
            if done:
                yield out(done)
                done = []
        if state is not None:
            yield out([row()])

    def out(rows):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[k][0] for r in rows], t) for k, t in enumerate(kinds)], names)

    return turns.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
