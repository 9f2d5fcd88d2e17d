"""Streaming forms of the work journal (K2) and the training-sample monitor
(K3, A7)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlens.functions.text import parse_explanation
from txnlens.operators.journal import latest_by_key
from txnlens.streaming.tail import tail_json

JOURNAL_SCHEMA = "row_idx long, summary string, features_json string, fraud_score double, label int, seq long"
SAMPLE_SCHEMA = "step long, reward double, mse double, explanation string"


def _placed(df: DataFrame) -> DataFrame:
    """Adds where each record lies: file time and name, split."""
    return df.select("*", F.col("_metadata.file_modification_time").alias("_time"),
                     F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))


def _with_place(df: DataFrame) -> DataFrame:
    """One column ``_at`` with the record's place and its offset in the split.
    Records without ``seq`` are ordered by it."""
    return df.withColumn("_at", F.struct("_time", "_file", "_start", F.monotonically_increasing_id().alias("_pos"))).drop("_time", "_file", "_start")


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Batch read of JSONL records: malformed lines and records without a key
    are skipped; ``_at`` is each record's place (for :func:`latest_records`)."""
    df = _with_place(_placed(spark.read.schema(JOURNAL_SCHEMA).option("mode", "DROPMALFORMED").json(path)))
    return df.where(F.col("row_idx").isNotNull())


def latest_records(journal: DataFrame) -> DataFrame:
    """The last record of each key: by ``seq``, and by place where that is absent."""
    return latest_by_key(journal, "row_idx", "seq", ["_at"]).drop("_at")


# The done table is a folder of generations. A generation is an optional base
# (what a compaction wrote) and one folder for every batch appended since. A
# batch writes its own records only; readers keep the last record of each key,
# so a batch that is written twice changes nothing. Folder names do not depend
# on the stream's epoch, which starts again with a new checkpoint.

def _generations(spark: SparkSession, table_dir: str) -> list[int]:
    """Committed generations, oldest first (any Hadoop filesystem)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table_dir)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
    numbers = sorted(int(n.split("-", 1)[1]) for n in names if n.startswith("gen-"))
    done = lambda k: k == 0 or fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{table_dir}/gen-{k}/base/_SUCCESS"))
    return [k for k in numbers if done(k)]


def _parts(spark: SparkSession, table_dir: str, generation: int) -> list[str]:
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{table_dir}/gen-{generation}")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    success = lambda p: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return [s.getPath().toString() for s in fs.listStatus(root) if success(s.getPath())]


def upsert_batches(table_dir: str, compact_after: int = 64):
    """``foreachBatch`` writer: append the batch's records; after
    ``compact_after`` batches, compact."""

    def run(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        generation = (_generations(spark, table_dir) or [0])[-1]
        _with_place(batch).write.parquet(f"{table_dir}/gen-{generation}/batch-{uuid.uuid4().hex}")
        if len(_parts(spark, table_dir, generation)) > compact_after:
            compact(spark, table_dir)

    return run


def compact(spark: SparkSession, table_dir: str) -> None:
    """Write the last records as the base of a new generation. The generation
    before it stays for readers that have begun; older ones are removed."""
    known = _generations(spark, table_dir)
    if not known:
        return
    _latest(spark, table_dir, known[-1]).write.mode("overwrite").parquet(f"{table_dir}/gen-{known[-1] + 1}/base")
    for old in known[:-1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{table_dir}/gen-{old}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _latest(spark: SparkSession, table_dir: str, generation: int) -> DataFrame | None:
    parts = _parts(spark, table_dir, generation)
    return latest_by_key(spark.read.parquet(*parts), "row_idx", "seq", ["_at"]) if parts else None


def latest_table(spark: SparkSession, table_dir: str) -> DataFrame | None:
    """The done table: the last record of each key; None while there is none."""
    known = _generations(spark, table_dir)
    got = _latest(spark, table_dir, known[-1]) if known else None
    return None if got is None else got.drop("_at")


def stream_journal(spark: SparkSession, src_dir: str, table_dir: str, checkpoint: str):
    """Start the journal stream: new JSONL records -> upsert by key."""
    sdf = _placed(spark.readStream.schema(JOURNAL_SCHEMA).option("mode", "DROPMALFORMED").json(src_dir))
    sdf = sdf.where(F.col("row_idx").isNotNull())
    return (sdf.writeStream.foreachBatch(upsert_batches(table_dir))
            .option("checkpointLocation", checkpoint).start())


def step_metrics(sdf: DataFrame) -> DataFrame:
    """Per step: mean reward, mean mse, mean explanation length, n."""
    return (sdf.withColumn("explanation", parse_explanation(F.coalesce("explanation", F.lit(""))))
            .groupBy("step").agg(F.avg("reward").alias("mean_reward"), F.avg("mse").alias("mean_mse"),
                                 F.avg(F.length("explanation")).alias("mean_explanation_chars"),
                                 F.count(F.lit(1)).alias("n")))


def stream_step_metrics(spark: SparkSession, src_dir: str) -> DataFrame:
    """Follow a folder that new files of JSONL sample records are put into (lines
    that are not JSON are skipped); :func:`follow_step_metrics` follows files that
    grow."""
    sdf = spark.readStream.schema(SAMPLE_SCHEMA).option("mode", "DROPMALFORMED").json(src_dir)
    return step_metrics(sdf.where(F.col("step").isNotNull()))


def follow_journal(spark: SparkSession, path: str, table_dir: str, checkpoint: str):
    """As :func:`stream_journal`, but ``path`` is a file, or a folder of files, that
    records are appended to; see :mod:`txnlens.streaming.tail`. Records without
    ``seq`` are ordered by file and place."""
    sdf = tail_json(spark, path, JOURNAL_SCHEMA, "row_idx").withColumn("_time", F.lit(0).cast("timestamp"))
    return (sdf.writeStream.foreachBatch(upsert_batches(table_dir))
            .option("checkpointLocation", checkpoint).start())


def follow_step_metrics(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`stream_step_metrics`, for a file, or files, that samples are appended
    to."""
    return step_metrics(tail_json(spark, path, SAMPLE_SCHEMA, "step"))


def append_records(df: DataFrame, path: str) -> None:
    """Append finished records to the journal folder as JSON lines (each call
    adds files; readers keep the last ``seq`` per key)."""
    df.select(*[c.split()[0] for c in JOURNAL_SCHEMA.split(", ")]).write.mode("append").json(path)
