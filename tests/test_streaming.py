import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from txnlens.operators.causal import causal_features
from txnlens.streaming.causal import stream_causal_features
from txnlens.streaming.journal import (latest_table, read_journal, stream_journal,
                                       stream_step_metrics)

SCHEMA = "txn_id long, card_id long, ts_sec long, amt double"


def _write(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)


def test_stream_equals_batch(spark, tmp_path):
    base = 1_700_000_000  # fixture times are relative; streams use absolute event time
    rel = [(1, 7, 0, 10.0), (2, 7, 3600, 10.0), (3, 7, 3601, 20.0), (4, 7, 86400, 20.0),
           (5, 7, 86401, 30.0), (6, 8, 100, 5.0), (7, 8, 100, 6.0), (8, None, 50, 1.0),
           (9, 8, 5000, 7.0)]
    rows = [(i, c, base + t, a) for i, c, t, a in rel]
    batch = {r.txn_id: r for r in causal_features(spark.createDataFrame(rows, SCHEMA)).collect()}
    shuffled = rows[:]
    random.Random(3).shuffle(shuffled)
    src = tmp_path / "src"
    # three files arriving in order; rows shuffled inside the watermark
    for k, chunk in enumerate([shuffled[:3], shuffled[3:6], shuffled[6:]]):
        _write(spark, chunk, str(src / f"part{k}"))
    late_and_close = [(100, 7, base + 10, 99.0), (101, 99, base + 10 ** 6, 1.0)]
    sdf = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true") \
        .option("maxFilesPerTrigger", 1).parquet(str(src))
    q = (stream_causal_features(sdf, delay="2 days").writeStream.format("memory")
         .queryName("k1_out").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ck")).start())
    q.processAllAvailable()
    _write(spark, late_and_close[1:], str(src / "part8"))
    q.processAllAvailable()
    _write(spark, late_and_close[:1], str(src / "part9"))
    q.processAllAvailable()
    dropped = sum(s.get("numRowsDroppedByWatermark", 0) for p in q.recentProgress
                  for s in p["stateOperators"])
    q.stop()
    assert dropped >= 1  # the late row is counted by Spark
    got = {r.txn_id: r for r in spark.sql("select * from k1_out").collect()}
    for k, b in batch.items():
        g = got[k]
        assert (g.velocity_1h, g.velocity_24h) == (b.velocity_1h, b.velocity_24h), k
        assert g.amt_zscore == pytest.approx(b.amt_zscore, rel=1e-9, abs=1e-9)
        assert g.card_tenure_days == pytest.approx(b.card_tenure_days)
    assert 100 not in got  # late row dropped


def test_journal_stream_upsert(spark, tmp_path):
    src = tmp_path / "jsrc"
    src.mkdir()
    recs = [{"row_idx": 1, "summary": "- a", "seq": 0}, {"row_idx": 2, "summary": "- b", "seq": 0}]
    (src / "a.jsonl").write_text("\n".join(json.dumps(r) for r in recs) + "\nnot json\n\n")
    table = str(tmp_path / "done")
    q = stream_journal(spark, str(src), table, str(tmp_path / "ck"))
    q.processAllAvailable()
    (src / "b.jsonl").write_text(json.dumps({"row_idx": 1, "summary": "- a2", "seq": 1}) + "\n")
    q.processAllAvailable()
    q.stop()
    done = {r.row_idx: r.summary for r in latest_table(spark, table).collect()}
    assert done == {1: "- a2", 2: "- b"}
    assert read_journal(spark, str(src)).count() == 3


def test_journal_survives_a_new_checkpoint(spark, tmp_path):
    """Epochs start again with a new checkpoint; nothing that was written is lost,
    a record without seq counts, and compaction changes no answer."""
    from txnlens.streaming.journal import compact
    table = str(tmp_path / "done")
    for k, recs in enumerate([[{"row_idx": 1, "summary": "a", "seq": 0}, {"row_idx": 2, "summary": "b"}], [{"row_idx": 3, "summary": "c", "seq": 5}]]):
        src = tmp_path / f"src{k}"
        src.mkdir()
        (src / "r.jsonl").write_text("\n".join(map(json.dumps, recs)) + "\n")
        q = stream_journal(spark, str(src), table, str(tmp_path / f"ck{k}"))
        q.processAllAvailable()
        q.stop()
    want = {1: "a", 2: "b", 3: "c"}
    for _ in range(3):
        assert {r.row_idx: r.summary for r in latest_table(spark, table).collect()} == want
        compact(spark, table)


def test_stream_nulls_equal_batch(spark, tmp_path):
    """Null amounts, a null time, a null id and text card numbers."""
    base = 1_700_000_000
    rows = [(1, "4x", base, 10.0), (2, "4x", base + 10, 12.0), (3, "4x", base + 20, None), (4, "4x", base + 30, 30.0),
            (5, "4x", None, 1.0), (None, "4x", base + 40, 8.0), (7, None, base, 1.0)]
    schema = "txn_id long, card_id string, ts_sec long, amt double"
    batch = {r.txn_id: r for r in causal_features(spark.createDataFrame(rows, schema), strategy="window").collect()}
    src = str(tmp_path / "src")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src + "/a")
    sdf = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src)
    q = (stream_causal_features(sdf).writeStream.format("memory").queryName("k1_nulls").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ck")).start())
    q.processAllAvailable()
    spark.createDataFrame([(99, "z", base + 10 ** 6, 1.0)], schema).coalesce(1).write.parquet(src + "/b")
    q.processAllAvailable()
    q.stop()
    got = {r.txn_id: r for r in spark.sql("select * from k1_nulls").collect()}
    for k, b in batch.items():
        g = got[k]
        assert (g.velocity_1h, g.velocity_24h) == (b.velocity_1h, b.velocity_24h), k
        assert g.amt_zscore == (None if b.amt_zscore is None else pytest.approx(b.amt_zscore, rel=1e-9)), k
        assert g.card_tenure_days == pytest.approx(b.card_tenure_days)


def test_many_cards_share_few_groups(spark, tmp_path):
    """Cards dealt into three groups, over several batches, some rows late: every
    card keeps a history and a buffer of its own."""
    base, rnd = 1_700_000_000, random.Random(7)
    rows = [(i, rnd.randrange(40), base + 600 * (i // 4) + rnd.randrange(600), None if i % 9 == 0 else rnd.randrange(1000) / 8) for i in range(800)]
    batch = {r.txn_id: r for r in causal_features(spark.createDataFrame(rows, SCHEMA), strategy="window").collect()}
    src = tmp_path / "src"
    for k in range(4):
        chunk = rows[200 * k: 200 * k + 200]
        rnd.shuffle(chunk)
        _write(spark, chunk + ([(5000, 3, base, 1.0)] if k == 3 else []), str(src / f"p{k}"))
    sdf = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(src))
    q = (stream_causal_features(sdf, buckets=3).writeStream.format("memory").queryName("k1_groups").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ck")).start())
    q.processAllAvailable()
    _write(spark, [(9999, 99, base + 10 ** 7, 1.0)], str(src / "p9"))
    q.processAllAvailable()
    states = max(s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"])
    q.stop()
    assert states <= 3
    got = {r.txn_id: r for r in spark.sql("select * from k1_groups").collect()}
    assert set(batch) == set(got) - {9999}
    for key, b in batch.items():
        g = got[key]
        assert (g.card_id, g.ts_sec, g.velocity_1h, g.velocity_24h) == (b.card_id, b.ts_sec, b.velocity_1h, b.velocity_24h)
        assert g.amt_zscore == (None if b.amt_zscore is None else pytest.approx(b.amt_zscore, rel=1e-9, abs=1e-9))
        assert g.card_tenure_days == pytest.approx(b.card_tenure_days)


def test_step_metrics_stream(spark, tmp_path):
    src = tmp_path / "samples"
    src.mkdir()
    lines = [json.dumps({"step": s, "reward": -0.1 * s, "mse": 0.1 * s,
                         "explanation": "<explanation>\nxy\n</explanation>"}) for s in (1, 1, 2)]
    (src / "s.jsonl").write_text("\n".join(lines) + "\ngarbage\n")
    q = (stream_step_metrics(spark, str(src)).writeStream.format("memory").queryName("k3_out")
         .outputMode("complete").start())
    q.processAllAvailable()
    q.stop()
    got = {r.step: r for r in spark.sql("select * from k3_out").collect()}
    assert got[1].n == 2 and got[2].n == 1
    assert got[1].mean_explanation_chars == 2.0


def test_stream_equals_batch_on_events(spark, tmp_path):
    from conftest import SF001
    from txnlens.sources import tables as T
    txn = T.txn(spark, SF001).select("txn_id", "card_id", "ts_sec", "amt")
    batch = {r.txn_id: r for r in causal_features(txn).collect()}
    rows = sorted((tuple(r) for r in txn.collect()), key=lambda r: (r[2], r[0]))
    k = len(rows) // 5
    src = tmp_path / "ev"
    rnd = random.Random(0)
    for i in range(5):
        chunk = rows[i * k:(i + 1) * k] if i < 4 else rows[4 * k:]
        rnd.shuffle(chunk)
        _write(spark, chunk, str(src / f"p{i}"))
    sdf = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true") \
        .option("maxFilesPerTrigger", 1).parquet(str(src))
    q = (stream_causal_features(sdf, delay="1 hour").writeStream.format("memory")
         .queryName("k1_events").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ck")).start())
    q.processAllAvailable()
    _write(spark, [(10 ** 9, 10 ** 9, rows[-1][2] + 10 ** 6, 0.0)], str(src / "p9"))
    q.processAllAvailable()
    q.stop()
    got = {r.txn_id: r for r in spark.sql("select * from k1_events").collect()}
    assert set(batch) <= set(got)
    for key, b in batch.items():
        g = got[key]
        assert (g.velocity_1h, g.velocity_24h) == (b.velocity_1h, b.velocity_24h)
        assert g.amt_zscore == pytest.approx(b.amt_zscore, rel=1e-9, abs=1e-9)
        assert g.card_tenure_days == pytest.approx(b.card_tenure_days)
