"""Committed tables: attempts that die, repeats, pruning, empty and null keys."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from txnlens.sources.versions import commit_table, manifest, read_committed


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, v double, train_split string")


def got(spark, path):
    return sorted((r.id, r.v, r.train_split or "") for r in read_committed(spark, path).collect())


def test_commits(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        read_committed(spark, path)
    first = frame(spark, [(1, 1.0, "train"), (2, 2.0, "val"), (3, 3.0, None)])
    assert commit_table(first, path, "a")
    assert not commit_table(first.limit(1), path, "a")
    assert got(spark, path) == [(1, 1.0, "train"), (2, 2.0, "val"), (3, 3.0, "")]
    fresh = frame(spark, [(2, 20.0, "val"), (4, 4.0, "test")])
    dying = fresh.withColumn("v", F.when(F.col("id") == 4, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("v")))
    with pytest.raises(PySparkException):
        commit_table(dying, path, "b")
    assert got(spark, path) == [(1, 1.0, "train"), (2, 2.0, "val"), (3, 3.0, "")]
    assert commit_table(fresh, path, "b")
    assert got(spark, path) == [(1, 1.0, "train"), (2, 20.0, "val"), (3, 3.0, ""), (4, 4.0, "test")]
    assert manifest(spark, path)["runs"] == ["a", "b"]
    assert commit_table(fresh.limit(0), path, "c") and len(got(spark, path)) == 4
    assert commit_table(fresh.limit(0), path, "d", replace="all") and got(spark, path) == []
    assert read_committed(spark, path).columns == ["id", "v", "train_split"]


def test_other_columns_raise(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    commit_table(frame(spark, [(1, 1.0, "train")]), path, "a")
    with pytest.raises(ValueError, match="columns"):
        commit_table(frame(spark, [(1, 1.0, "train")]).drop("v"), path, "b")


def test_a_generation_is_written_once(spark, tmp_path):
    from txnlens.sources.versions import _publish
    path = f"file://{tmp_path}/t"
    commit_table(frame(spark, [(1, 1.0, "train")]), path, "a")
    with pytest.raises(RuntimeError, match="another writer"):
        _publish(spark, path, manifest(spark, path))


def test_splits_are_pruned(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    commit_table(frame(spark, [(i, float(i), s) for i in range(9) for s in ("train", "val")]), path, "a")
    commit_table(frame(spark, [(1, 5.0, "val")]), path, "b")
    val = read_committed(spark, path).where(F.col("train_split") == "val")
    plan = val._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(train_split" in plan
    assert [p.rsplit("/", 2)[0].endswith("run=b") for p in val.inputFiles()].count(True) == 1
    assert [(r.id, r.v) for r in val.collect()] == [(1, 5.0)]
