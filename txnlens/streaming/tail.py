"""Follow files of lines that grow in place.

Spark's file stream takes every path once, so lines appended to a file it has read are
never seen. This source's offsets are byte positions, one a file: a batch is the bytes
that were added since the last one, up to the last line break, so a line that is only
half written waits for its rest. Offsets are in the stream's checkpoint; a batch that
is read again after a lost executor, or by a query that starts again, reads the same
bytes. The driver looks at names and sizes, and at the end of a file that has grown for its
last line break; the bytes are read in tasks, at most ``CHUNK`` a task and one Arrow
batch of about ``BATCH`` at a time.

Files may be a single one or all in a folder (names that begin with ``_`` or ``.`` are
not read), on any file system that ``pyarrow.fs`` opens by its URI. They must only
grow: one that is shorter than what was read from it stops the stream with an error.
The offset names every file, so the source is meant for files that grow, not for
folders of millions of them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a task and of a batch of lines.
CHUNK, BATCH = 64 << 20, 4 << 20
_BLOCK = 1 << 16
LINE_SCHEMA = "file string, at long, line string"


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _last_break(fs: pafs.FileSystem, path: str, size: int, floor: int) -> int:
    """The position behind the last line break of ``[floor, size)``, or ``floor``."""
    with fs.open_input_file(path) as f:
        end = size
        while end > floor:
            begin = max(floor, end - _BLOCK)
            f.seek(begin)
            k = f.read(end - begin).rfind(b"\n")
            if k >= 0:
                return begin + k + 1
            end = begin
    return floor


class Stretch(InputPartition):
    """Lines of ``file`` that begin in ``[begin, end)``; ``start`` is where the batch's
    first line of the file begins."""

    def __init__(self, file: str, start: int, begin: int, end: int) -> None:
        self.file, self.start, self.begin, self.end = file, start, begin, end


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, chunk: int) -> None:
        self.path, self.chunk = path, chunk
        self._known: dict[str, tuple[int, int]] = {}  # size and last break when last looked at

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, root = _opened(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.Directory:
            infos = [i for i in fs.get_file_info(pafs.FileSelector(root)) if i.is_file and i.base_name[:1] not in "_."]
        else:
            infos = [info] if info.is_file else []
        ends = {}
        for i in sorted(infos, key=lambda i: i.path):
            size, done = self._known.get(i.path, (0, 0))
            if i.size != size:
                done = _last_break(fs, i.path, i.size, min(done, i.size))
                self._known[i.path] = (i.size, done)
            ends[i.path] = done
        return ends

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        out = []
        for file, stop in end.items():
            begin = start.get(file, 0)
            if stop < begin:
                raise ValueError(f"{file} is shorter than what was read from it")
            out += [Stretch(file, begin, k, min(k + self.chunk, stop)) for k in range(begin, stop, self.chunk)]
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        fs, _ = _opened(self.path)
        with fs.open_input_file(partition.file) as f:
            for places, lines in _line_batches(f, partition):
                yield pa.RecordBatch.from_arrays([pa.array([partition.file] * len(lines), pa.string()), pa.array(places, pa.int64()), pa.array(lines, pa.string())], ["file", "at", "line"])


def _line_batches(f, p: Stretch) -> Iterator[tuple[list[int], list[str]]]:
    """Places and texts of the lines that begin in the stretch; blank lines are left
    out, bytes that are no UTF-8 are replaced."""
    at, rest = p.begin, b""
    skip = p.begin > p.start
    if skip:  # a line that begins before belongs to the stretch before
        at -= 1
    f.seek(at)
    size = f.size()
    while at < p.end or rest:
        block = f.read(min(BATCH, size - at - len(rest)))
        if not block:
            return  # what is left has no line break yet
        data = rest + block
        k = data.rfind(b"\n")
        if k < 0:
            rest = data
            continue
        places, lines = [], []
        place = at
        for line in data[:k].split(b"\n"):
            if skip:
                skip = False
            elif place >= p.end:
                break
            elif line.strip():
                places.append(place)
                lines.append(line.decode("utf-8", "replace"))
            place += len(line) + 1
        if lines:
            yield places, lines
        at, rest = at + k + 1, data[k + 1:]
        if at >= p.end:
            return


class TailSource(DataSource):
    """``spark.readStream.format("tail").load(path)``: file, at (the byte at which the
    line begins) and line. Option ``chunkBytes``: bytes of a task."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return LINE_SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], int(self.options.get("chunkBytes", CHUNK)))


def tail_lines(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """A stream of the lines of a file, or of the files of a folder, as they grow."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("tail").option("chunkBytes", str(chunk)).load(path)


def tail_json(spark: SparkSession, path: str, schema: str, required: str, chunk: int = CHUNK) -> DataFrame:
    """The records of growing JSON-lines files, with ``file`` and ``at`` as _file and
    _start. Lines that are not JSON or lack the ``required`` field are skipped."""
    parsed = tail_lines(spark, path, chunk).select(F.col("file").alias("_file"), F.col("at").alias("_start"), F.from_json("line", schema).alias("r"))
    return parsed.select("r.*", "_file", "_start").where(F.col(required).isNotNull())


def grow(df: DataFrame, folder: str, order: list[str], line: str, stage: str, until: int, torn: int = 0) -> int:
    """Write the lines of ``df`` (text column ``line``) to one file a partition, in
    ``order``, those with ``stage`` <= ``until``; of the first line after them ``torn``
    characters follow without a line break. Called again with a greater ``until`` the
    files have grown: what was there is written as it was. Returns the lines written."""
    def write(batches):
        from pyspark import TaskContext
        fs, root = _opened(folder)
        fs.create_dir(root, recursive=True)
        n = 0
        with fs.open_output_stream(f"{root}/part-{TaskContext.get().partitionId():05d}.jsonl") as out:
            for b in batches:
                for text, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if at > until:
                        out.write(text.encode()[:torn])
                        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])
                        return
                    out.write(text.encode() + b"\n")
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows = df.sortWithinPartitions(stage, *order).select(line, stage)
    return rows.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def record_line(columns: list[str]) -> str:
    """SQL for a row's columns as one line of JSON."""
    return f"to_json(named_struct({', '.join(f'{json.dumps(c)}, `{c}`' for c in columns)}))"
