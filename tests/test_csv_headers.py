"""Header lines: one job for all files, compressed files, byte-order marks, names that
are absent or repeat."""

import gzip

from pyspark.sql import functions as F

from txnlens.sources import ingest as I


def test_headers_of_many_files_are_one_job(spark, tmp_path):
    for i in range(60):
        names = ["TransactionID", "DeviceType", "DeviceInfo"] if i % 2 else ["DeviceInfo", "TransactionID", "DeviceType"]
        value = {"TransactionID": str(i), "DeviceType": "mobile", "DeviceInfo": f"info {i}"}
        (tmp_path / f"p{i:03d}.csv").write_text(",".join(names) + "\n" + ",".join(value[n] for n in names) + "\n")
    sc = spark.sparkContext
    sc.setJobGroup("headers", "headers")
    try:
        found = I._headers(spark, str(tmp_path), False)
        assert len(sc.statusTracker().getJobIdsForGroup("headers")) == 1
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert [len(v) for v in found.values()] == [30, 30]
    rows = {r.TransactionID: r.DeviceInfo for r in I._csv(spark, str(tmp_path), I.IDENTITY_SCHEMA).collect()}
    assert rows == {i: f"info {i}" for i in range(60)}


def test_odd_headers(spark, tmp_path):
    (tmp_path / "a b%20.csv").write_bytes("﻿TransactionID,,DeviceType,DeviceType,\"Device\"\r\n1,x,mobile,y,z\r\n".encode())
    with gzip.open(tmp_path / "c.csv.gz", "wt") as f:
        f.write("TransactionID,DeviceType,note\n2,desktop,q\n")
    (tmp_path / "empty.csv").write_text("")
    found = I._headers(spark, str(tmp_path), True)
    assert sorted(found) == [("TransactionID", "DeviceType", "note"), ("TransactionID", "_c1", "DeviceType", "_c3", "Device")]
    schema = I.T.StructType([f for f in I.IDENTITY_SCHEMA if f.name != "DeviceInfo"])
    rows = {r.TransactionID: r.DeviceType for r in I._csv(spark, str(tmp_path), schema, recursive=True).select(F.col("TransactionID"), F.col("DeviceType")).collect()}
    assert rows == {1: "mobile", 2: "desktop"}
