"""Token ids in seekable binary files: one zstandard frame per document.

A file holds, in order: the documents' frames, each independent and with its own
content checksum; a skippable frame with the documents' keys and token counts;
and a skippable frame with the seek table of the public zstd seekable format
(compressed size, raw size and the low 32 bits of the raw bytes' XXH64 for every
frame, then the count and its magic number). A reader fetches the tail, then
only the frames it wants. Any zstd tool can still decompress the whole file.

Rows are sorted by key (null first, equal keys by content), so that files in
shard order, and documents in file order, are the corpus in key order. Files are
written under a temporary name and moved, so a repeated task leaves one file.

Defined results: a null or empty text has only its end id; no rows, no files.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import shared_path
from .common import held, in_batches, steps, written

#: Fixed values of the public zstd seekable format.
SKIPPABLE, SEEK_SKIPPABLE, SEEK_MAGIC, HAS_CHECKSUM = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
DOCS_PER_FILE = 8192
#: Entries of each memo; a full one is emptied.
MEMO = 1_200_000
#: Bytes of text that are encoded at once.
STEP_CHARS = 8 << 20
_SPACES = re.compile(r"[^\S\x1c-\x1f]+")


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


class RunEncoder:
    """The tokenizers library, called once for each distinct word. Texts are split
    at white space by Arrow and their distinct runs looked up; a new run is split
    into words by the vocabulary's own pattern, and new words go to the library
    joined by blanks, where the end-of-word mark tells them apart. Runs for which
    this could differ from the whole text's encoding (characters beyond U+024F,
    special strings, other kinds of vocabulary) go to the library as they are: no
    word crosses white space."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.odd = regex.compile("|".join(["[\u0130\u0250-\U0010FFFF]", *(regex.escape(a["content"]) for a in spec.get("added_tokens", []))]))
        suffix = spec["model"].get("end_of_word_suffix")
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        self.pattern = regex.compile(split["pattern"]["Regex"]) if suffix and steps == ["NFC", "Replace", "Lowercase"] and split.get("type") == "Split" and split.get("invert") else None
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)
        self.runs: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _add_words(self, words: set[str]) -> None:
        if len(self.words) + len(words) > MEMO:
            self.words.clear()
        new = [w for w in words if w not in self.words]
        for at in range(0, len(new), 1000):
            some = new[at: at + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.dtype)
            cuts = np.flatnonzero(self.ends[ids])
            if len(cuts) != len(some):
                raise ValueError("a word has no single end mark")
            raw, width, last = ids.tobytes(), self.dtype.itemsize, 0
            for w, end in zip(some, (cuts + 1).tolist()):
                self.words[w] = raw[last * width: end * width]
                last = end

    def _add_runs(self, new: list[str]) -> None:
        odd = new if self.pattern is None else [r for r in new if self.odd.search(r)]
        plain = [] if self.pattern is None else [r for r in new if not self.odd.search(r)] if odd else new
        split = [self.pattern.findall(r.lower()) for r in plain]
        self._add_words({w for ws in split for w in ws})
        words = self.words
        for r, ws in zip(plain, split):
            self.runs[r] = words[ws[0]] if len(ws) == 1 else b"".join([words[w] for w in ws])
        for at in range(0, len(odd), 20_000):
            some = odd[at: at + 20_000]
            for r, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self.runs[r] = np.array(e.ids, self.dtype).tobytes()

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Each text's ids. ``texts``: an Arrow string array; null is empty."""
        texts = texts.fill_null("")
        lists = pc.utf8_split_whitespace(texts)
        if pc.any(pc.match_substring_regex(texts, "[\x1c-\x1f]")).as_py():  # Arrow splits at these too, the vocabulary does not
            lists = pa.array([[r for r in _SPACES.split(t) if r] for t in texts.to_pylist()], pa.list_(pa.string()))
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.runs) + len(distinct) > MEMO:
            self.runs.clear()
        known = self.runs
        if new := [r for r in distinct if r and r not in known]:
            self._add_runs(new)
        parts = [known[r] if r else b"" for r in distinct]
        every = np.frombuffer(b"".join(parts), self.dtype)
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // self.dtype.itemsize
        index = coded.indices.to_numpy(zero_copy_only=False)
        count = size[index]
        ends = np.concatenate([[0], np.cumsum(count)])
        ids = every[np.repeat((np.cumsum(size) - size)[index] - ends[:-1], count) + np.arange(ends[-1])]
        return np.split(ids, ends[lists.offsets.to_numpy()[1:-1]]) if len(texts) else []


def run_encoder(path: str) -> RunEncoder:
    return held(("runs", path), lambda: RunEncoder(path))


def wide(ids: bytes, dtype: np.dtype) -> bytes:
    """As little-endian unsigned 32-bit integers."""
    return np.frombuffer(ids, dtype).astype("<u4").tobytes()


class FrameWriter:
    def __init__(self, out, dtype: np.dtype) -> None:
        self.out, self.dtype = out, dtype
        self.keys: list[int | None] = []
        self.counts: list[int] = []
        self.table = bytearray()

    def add(self, key: int | None, n: int, frame: bytes, raw_size: int, check: int) -> None:
        self.out.write(frame)
        self.keys.append(key)
        self.counts.append(n)
        self.table += struct.pack("<III", len(frame), raw_size, check)

    def close(self) -> None:
        n = len(self.keys)
        index = struct.pack("<IB", n, self.dtype.itemsize) + np.array([k is None for k in self.keys], "u1").tobytes() + np.array([k or 0 for k in self.keys], "<i8").tobytes() + np.array(self.counts, "<i8").tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE, len(index)) + index)
        self.out.write(struct.pack("<II", SEEK_SKIPPABLE, len(self.table) + 9) + bytes(self.table) + struct.pack("<IBI", n, HAS_CHECKSUM, SEEK_MAGIC))
        self.out.close()


class FrameReader:
    """Random access to one file's documents."""

    def __init__(self, file) -> None:
        self.file = file
        size = file.size()
        file.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table")
        table_at = size - 9 - 12 * n
        file.seek(table_at)
        self.table = np.frombuffer(file.read(12 * n), "<u4").reshape(n, 3)
        self.offsets = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        at = int(self.offsets[-1])
        file.seek(at + 8)
        _, width = struct.unpack("<IB", file.read(5))
        self.dtype = np.dtype(f"<u{width}")
        null = np.frombuffer(file.read(n), "u1")
        keys = np.frombuffer(file.read(8 * n), "<i8")
        self.keys = [None if z else int(k) for z, k in zip(null, keys)]
        self.counts = np.frombuffer(file.read(8 * n), "<i8")
        self._zstd = zstandard.ZstdDecompressor()

    def raw(self, k: int) -> bytes:
        """Document ``k``'s ids; reads and decompresses its frame only."""
        self.file.seek(int(self.offsets[k]))
        frame = self.file.read(int(self.table[k, 0]))
        raw = self._zstd.decompress(frame, max_output_size=int(self.table[k, 1]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"checksum of document {k} does not match")
        return raw

    def ids(self, k: int) -> np.ndarray:
        return np.frombuffer(self.raw(k), self.dtype)


def key_bounds(df: DataFrame, key: str, docs_per_file: int) -> list[int]:
    """Upper keys of all files but the last, from a scan of the key column: about
    ``docs_per_file`` rows each. Only balance depends on them, not the result."""
    n = df.select(key).count()
    files = max(1, -(-n // docs_per_file))
    if files == 1:
        return []
    at = ",".join(f"{k / files:.9f}D" for k in range(1, files))
    got = df.select(F.expr(f"percentile_approx(`{key}`, array({at}), {max(10_000, 4 * files)})")).first()[0]
    return sorted(set(got or []))


def write_frames(df: DataFrame, path: str, folder: str, end_id: int | None = None, key: str = "doc_id",
                 text_column: str = "text", docs_per_file: int = DOCS_PER_FILE) -> DataFrame:
    """Encode every text, append ``end_id`` and write the files below ``folder``,
    a place that executors and driver share. Encoding and compression come before
    the one exchange, so that only frames are shuffled. Returns a row for each
    file: shard, file, n_docs, n_tokens."""
    bounds = np.array(key_bounds(df, key, docs_per_file), np.int64)

    def encode(batches: Iterator[pa.RecordBatch]):
        enc = run_encoder(path)
        tail = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        zstd = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        for b in batches:
            for part in steps(b, 1, STEP_CHARS):
                raws = [ids.tobytes() + tail for ids in enc.encode(part.column(1))]
                keys = part.column(0)
                shard = np.searchsorted(bounds, keys.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), "left")
                yield pa.RecordBatch.from_arrays([
                    pa.array(shard, pa.int32()), keys, pa.array([len(r) // enc.dtype.itemsize for r in raws], pa.int64()),
                    pa.array([len(r) for r in raws], pa.int64()), pa.array([xxhash.xxh64_intdigest(r) & 0xFFFFFFFF for r in raws], pa.int64()),
                    pa.array([zstd.compress(r) for r in raws], pa.binary())], ["shard", "key", "n", "raw_size", "xxh", "frame"])

    def write(batches: Iterator[pa.RecordBatch]):
        out, fs, shard, final = None, None, None, ""
        for b in batches:
            for row in b.to_pylist():
                if out is None:
                    fs, base = opened(folder)
                    fs.create_dir(base, recursive=True)
                    shard, final = row["shard"], f"{base}/part-{row['shard']:06d}.ids.zst"
                    temporary = f"{final}.{uuid.uuid4().hex}.tmp"
                    out = FrameWriter(fs.open_output_stream(temporary), run_encoder(path).dtype)
                out.add(row["key"], row["n"], row["frame"], row["raw_size"], row["xxh"])
        if out is not None:
            out.close()
            fs.move(temporary, final)
            yield pa.RecordBatch.from_pylist([{"shard": shard, "file": f"{folder}/part-{shard:06d}.ids.zst", "n_docs": len(out.keys), "n_tokens": sum(out.counts)}],
                                             pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    frames = in_batches(df).select(F.col(key).cast("long").alias("key"), F.col(text_column).alias("text")).mapInArrow(
        encode, "shard int, key long, n long, raw_size long, xxh long, frame binary")
    dealt = frames.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions(F.col("key").asc_nulls_first(), "xxh", "n")
    return written(dealt.mapInArrow(write, "shard int, file string, n_docs long, n_tokens long"), "frame-files")


def with_starts(files: DataFrame) -> DataFrame:
    """Each file's first token position in the corpus: a running sum over one row
    a file."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("file_start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_frames(files: DataFrame, key: str = "doc_id", only: list[int] | None = None, ids: bool = False) -> DataFrame:
    """Per document of the files: key, start (ids before it in the corpus),
    n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)
    and, if asked, the ids. ``only``: keys to read; other frames stay untouched."""
    wanted = None if only is None else set(only)
    schema = f"`{key}` long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for row in b.to_pylist():
                fs, at = opened(row["file"])
                with fs.open_input_file(at) as f:
                    reader = FrameReader(f)
                    starts = row["file_start"] + np.concatenate([[0], np.cumsum(reader.counts)[:-1]])
                    chosen = [k for k, x in enumerate(reader.keys) if wanted is None or x in wanted]
                    for lo in range(0, len(chosen), 1024):
                        some = chosen[lo: lo + 1024]
                        raws = [reader.raw(k) for k in some]
                        out = [pa.array([reader.keys[k] for k in some], pa.int64()), pa.array(starts[some], pa.int64()),
                               pa.array([len(r) // reader.dtype.itemsize for r in raws], pa.int64()),
                               pa.array([zlib.crc32(wide(r, reader.dtype)) for r in raws], pa.int64())]
                        if ids:
                            out.append(pa.array([np.frombuffer(r, reader.dtype).astype(np.int64) for r in raws], pa.list_(pa.int64())))
                        yield pa.RecordBatch.from_arrays(out, [key, "start", "n_tokens", "ids_crc32", *["ids"] * ids])

    n = max(1, files.count())
    return with_starts(files).repartitionById(n, F.col("shard")).select("file", "file_start").mapInArrow(run, schema)


def token_files(df: DataFrame, path: str, end_id: int | None = None, key: str = "doc_id") -> DataFrame:
    """Write the corpus to a new shared folder and read it back."""
    folder = shared_path(df.sparkSession, "token-files")
    return read_frames(write_frames(df, path, folder, end_id, key), key)
