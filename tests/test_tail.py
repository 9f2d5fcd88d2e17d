"""Files that grow in place: byte offsets, half-written lines, restarts."""

import json
import random

import pytest

from txnlens.streaming import journal, tail


def lines_of(reader, start, end):
    return [(b.column(1)[k].as_py(), b.column(2)[k].as_py()) for p in reader.partitions(start, end) for b in reader.read(p) for k in range(b.num_rows)]


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 20])
def test_every_line_is_read_once_whatever_the_cuts(tmp_path, chunk, monkeypatch):
    monkeypatch.setattr(tail, "BATCH", 11)
    rng = random.Random(chunk)
    file, reader, text, done, got = tmp_path / "a.jsonl", tail.TailReader(str(tmp_path), chunk), "", {}, []
    file.write_bytes(b"")
    for _ in range(12):
        text += "".join(rng.choice(["x", "é", "\n", "line ", "\n\n", "日本"]) for _ in range(rng.randint(0, 30)))
        file.write_bytes(text.encode())
        end = reader.latestOffset()
        got += lines_of(reader, done, end)
        done = end
    whole = text.encode()[: done[str(file)]].split(b"\n")
    want, at = [], 0
    for line in whole[:-1]:
        if line.strip():
            want.append((at, line.decode()))
        at += len(line) + 1
    assert got == want and whole[-1] == b""


def test_a_fresh_reader_finds_the_same_offsets(tmp_path):
    (tmp_path / "a").write_bytes(b"one\ntwo\nhal")
    (tmp_path / "_hidden").write_bytes(b"no\n")
    (tmp_path / "b").write_bytes(b"no break")
    want = {str(tmp_path / "a"): 8, str(tmp_path / "b"): 0}
    assert tail.TailReader(str(tmp_path), 100).latestOffset() == want
    assert tail.TailReader(str(tmp_path / "a"), 100).latestOffset() == {str(tmp_path / "a"): 8}
    assert tail.TailReader(str(tmp_path / "none"), 100).latestOffset() == {}


def test_a_last_break_far_back(tmp_path):
    file = tmp_path / "a"
    file.write_bytes(b"one\n" + b"x" * 300_000)
    assert tail.TailReader(str(file), 100).latestOffset() == {str(file): 4}


def test_a_file_that_shrinks_stops_the_stream(tmp_path):
    with pytest.raises(ValueError, match="shorter"):
        tail.TailReader(str(tmp_path), 100).partitions({"f": 10}, {"f": 5})


def drained(query):
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_appended_records_reach_the_journal(spark, tmp_path):
    """One file, appended to between triggers and between runs, ends in a half line."""
    file, table, state = tmp_path / "in" / "journal.jsonl", str(tmp_path / "table"), str(tmp_path / "state")
    file.parent.mkdir()
    record = lambda row, text: json.dumps({"row_idx": row, "summary": text}) + "\n"
    file.write_text(record(1, "a") + "not json\n" + record(2, "b") + '{"summary": "no key"}\n' + '{"row_idx": 3, "summ')
    query = journal.follow_journal(spark, str(file), table, state)
    try:
        query.processAllAvailable()
        rows = lambda: {r.row_idx: r.summary for r in journal.latest_table(spark, table).collect()}
        assert rows() == {1: "a", 2: "b"}
        with file.open("a") as f:
            f.write('ary": "c"}\n' + record(1, "a again"))
        query.processAllAvailable()
        assert rows() == {1: "a again", 2: "b", 3: "c"}
    finally:
        query.stop()
    with file.open("a") as f:
        f.write(record(2, "b again") + record(4, "d"))
    drained(journal.follow_journal(spark, str(file), table, state))
    assert rows() == {1: "a again", 2: "b again", 3: "c", 4: "d"}


def test_samples_of_growing_files(spark, tmp_path):
    own = tmp_path / "in"
    own.mkdir()
    out = []

    def keep(batch, _):
        out[:] = [(r.step, r.n, r.mean_reward) for r in batch.orderBy("step").collect()]

    for turn in range(3):
        for k in range(2):
            with (own / f"{k}.jsonl").open("a") as f:
                f.write("".join(json.dumps({"step": s, "reward": float(turn), "mse": 0.5, "explanation": "x"}) + "\n" for s in range(4)))
        drained(journal.follow_step_metrics(spark, str(own)).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).start())
    assert out == [(s, 6, 1.0) for s in range(4)]
