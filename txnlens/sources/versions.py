"""A partitioned Parquet table whose commits are manifests (A4, C1).

``commit_table`` writes a run's rows below ``data/run=<run>/<key>=<value>`` and then
puts a new manifest beside them. A manifest names the folder that holds each partition,
so a run replaces the partitions that it wrote and leaves the others; readers follow
the newest manifest and never see an attempt that died before its commit. The attempt's
folder is overwritten when the run is tried again, and a run that is already committed
is left alone, so repeating a job is harmless.

``read_committed`` lists only the folders of the manifest; a filter on the key prunes
them before any file is opened.

Defined results: a run without rows replaces nothing (``replace="all"``: empties the
table); a null key is a partition; reading before any commit raises. One writer at a
time: where a store's rename refuses an existing name, the later of two writers raises.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

RUN = "run"


def _store(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), hadoop.Path


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _store(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at(path))) if fs.exists(at(path)) else []


def manifest(spark: SparkSession, path: str) -> dict | None:
    """The newest commit: generation, committed runs, folder of each partition, schema."""
    found = [n for n in _names(spark, f"{path}/manifests") if n.endswith(".json")]
    if not found:
        return None
    return json.loads("".join(r["value"] for r in spark.read.text(f"{path}/manifests/{found[-1]}", wholetext=True).collect()))


def _publish(spark: SparkSession, path: str, entry: dict) -> None:
    final = f"{path}/manifests/{entry['generation']:012d}.json"
    fs, at = _store(spark, final)
    part = at(f"{path}/manifests/.{entry['generation']:012d}.{entry['runs'][-1]}")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    if fs.exists(at(final)) or not fs.rename(part, at(final)):
        raise RuntimeError(f"{final}: another writer has committed this generation")


def commit_table(df: DataFrame, path: str, run: str, key: str = "train_split", replace: str = "written") -> bool:
    """Writes ``df`` as ``run`` and commits it. ``replace``: "written" keeps partitions
    that this run does not write, "all" drops them. False if the run was committed
    before; then nothing is written."""
    if replace not in ("written", "all"):
        raise ValueError(replace)
    spark = df.sparkSession
    last = manifest(spark, path) or {"generation": -1, "runs": [], "folders": {}, "schema": None}
    if run in last["runs"]:
        return False
    schema = T.StructType([f for f in df.schema if f.name != key] + [df.schema[key]]).json()
    if last["schema"] not in (None, schema) and replace != "all":
        raise ValueError(f"{path}: the table has other columns")
    folder = f"{RUN}={run}"
    df.write.mode("overwrite").partitionBy(key).parquet(f"{path}/data/{folder}")
    own = {n: f"{folder}/{n}" for n in _names(spark, f"{path}/data/{folder}") if n.startswith(f"{key}=")}
    kept = last["folders"] if replace == "written" else {}
    _publish(spark, path, {"generation": last["generation"] + 1, "runs": [*last["runs"], run], "folders": {**kept, **own}, "schema": schema})
    return True


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    entry = manifest(spark, path)
    if entry is None:
        raise FileNotFoundError(f"{path}: nothing committed")
    schema = T.StructType.fromJson(json.loads(entry["schema"]))
    if not entry["folders"]:
        return spark.createDataFrame([], schema)
    r = spark.read.schema(T.StructType([*schema, T.StructField(RUN, T.StringType())])).option("basePath", f"{path}/data")
    return r.parquet(*[f"{path}/data/{f}" for f in sorted(entry["folders"].values())]).drop(RUN)
