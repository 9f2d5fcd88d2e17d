"""Helpers that several operators share: shared-folder tables, row batches, tokens."""

from __future__ import annotations

import gc
import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path

# Spark's tasks are the parallelism; the tokenizers library adds no threads to it.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: A-Z to a-z, every other byte as it is.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: it is computed once,
    survives lost executors, and later plans start from a scan."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch, about. By rows alone, 10,000 long texts would be one.
BATCH_BYTES = 8 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_batches(df: DataFrame) -> DataFrame:
    """``df`` itself; its session sends Arrow batches of bounded size from now on."""
    now = df.sparkSession.conf.get(_BATCH_KEY, None)
    if now is None or not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        df.sparkSession.conf.set(_BATCH_KEY, str(BATCH_BYTES))
    return df


def map_rows(df: DataFrame, columns: list[str], schema: str,
             fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]) -> DataFrame:
    """``mapInArrow`` over the named columns only, so that clashing or unused
    columns neither travel nor matter."""
    return in_batches(df).select(*columns).mapInArrow(fn, schema)


def with_text(df: DataFrame, keep: tuple[str, ...], text_column: str, results: str,
              fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]) -> DataFrame:
    """``mapInArrow`` over the ``keep`` columns, by place, and the text behind them;
    ``fn`` returns the kept columns and then ``results``. The kept columns are
    k0, k1, ... in the output, so they clash with nothing; see :func:`named`."""
    kinds = [f"k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    own = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    schema = ", ".join([*kinds, results])
    if text_column not in keep:
        return in_batches(df).select(*own, F.col(text_column).alias("t")).mapInArrow(fn, schema)
    at = keep.index(text_column)

    def twice(batches):  # the text travels once
        return fn(pa.RecordBatch.from_arrays([*b.columns, b.column(at)], [*b.schema.names, "t"]) for b in batches)

    return in_batches(df).select(*own).mapInArrow(twice, schema)


def named(out: DataFrame, keep: tuple[str, ...], results: bool = True) -> DataFrame:
    """The kept columns under their own names and, with ``results``, the others;
    a kept column that has a result's name gives way to it."""
    own = out.columns[len(keep):] if results else []
    taken = {c.lower() for c in own}
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep) if c.lower() not in taken], *own)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of bytes other than ASCII space and tab to carriage
    return; ``bytes.split`` separates at exactly these."""
    return text.encode().translate(ASCII_LOWER).split() if text else []


_held: dict = {}


def held(key: tuple, make: Callable):
    """What an operator remembers from task to task in a Python worker. Workers
    serve all later stages too, so only the last operator's memory is kept."""
    if key not in _held:
        forget()
        _held[key] = make()
    return _held[key]


def forget() -> None:
    """For operators that remember nothing: drop what an earlier one left."""
    if _held:
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def steps(batch: pa.RecordBatch, column: int, chars: int) -> Iterator[pa.RecordBatch]:
    """Slices of about so many bytes of text, at least one row each."""
    texts = batch.column(column)
    total = at = 0
    for k in range(batch.num_rows):
        if texts[k].is_valid:
            total += texts[k].as_buffer().size
        if total >= chars:
            yield batch.slice(at, k + 1 - at)
            at, total = k + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def mix64(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijective scrambling of 64-bit values (multiply, shift, xor)."""
    x = (x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x


def few_by_hash(df: DataFrame, columns: list[str], limit: int, rows: int) -> DataFrame:
    """At most ``limit`` of the ``rows`` rows of ``df``, by the hash of ``columns``. A
    threshold on the hash comes first, so that no partition hands on more than its
    share; a tie at the limit is settled by the columns."""
    h = F.xxhash64(*columns)
    span = 1 << 40
    least = span if rows <= 2 * limit else int(span * (2 * limit / rows))
    return df.where(F.pmod(h, F.lit(span)) < least).orderBy(F.pmod(h, F.lit(span)), *columns).limit(limit)


def crc_mod(column: str, modulus: int):
    """crc32 of the column's decimal text, modulo ``modulus``; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus
