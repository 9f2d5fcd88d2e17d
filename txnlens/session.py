"""Session construction and cluster-shared paths."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job here relies on. Timestamps are compared in UTC; AQE
# re-plans joins and coalesces small shuffles at runtime.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "txnlens", extra: dict | None = None) -> SparkSession:
    """Build (or fetch) a session with the settings the library assumes.

    On a cluster the master and memory come from spark-submit; here only the
    semantic settings are pinned. ``shuffle_partitions`` is set only when given
    (tests, the bench); otherwise the cluster's own setting holds.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names in ``spark.checkpoint.dir``."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    return spark.sparkContext.getCheckpointDir()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's checkpoint folder. Only a local-mode session (tests)
    without one gets a private folder; on a cluster a missing setting is an
    error, never a machine-local fallback."""
    d = checkpoint_dir(spark)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        d = tempfile.mkdtemp(prefix="txnlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
        spark.sparkContext.setCheckpointDir(d)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder, which driver and executors share;
    it is removed when the application ends."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    if "://" not in base and not base.startswith("file:"):
        base = f"file://{base}"
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def cut_lineage(df):
    """Reliable checkpoint into the shared checkpoint folder (ensured first,
    since a caller's session may not have set one in its SparkContext)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
