"""What reaches the driver for the fit."""

import pytest

from txnlens.llm import toxicity


@pytest.fixture(scope="module")
def ids():
    import zlib
    return [k for k in range(400) if zlib.crc32(str(k).encode()) % toxicity.HELD_OUT][:40]


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_a_repeated_labelled_id_counts_once(spark, ids):
    docs = [(i, f"text {i} {k} " + "x " * k) for i in ids[:3] for k in range(1000)] + [(i, "other") for i in ids[3:]]
    texts, labels = toxicity.labelled_sample(*frames(spark, docs, [(i, i % 2) for i in ids] * 2))
    assert len(texts) == len(labels) == len(ids)
    assert {t for t in texts if t.startswith("text")} == {f"text {i} 0 " for i in ids[:3]}  # the shortest


def test_conflicting_labels_are_toxic(spark, ids):
    _, labels = toxicity.labelled_sample(*frames(spark, [(i, "a") for i in ids], [(i, k) for i in ids for k in (0, 1)]))
    assert labels.tolist() == [1.0] * len(ids)


def test_a_label_whose_texts_are_all_too_long(spark, ids):
    docs = [(i, "word " * (100 + k) if i % 2 else "short") for k, i in enumerate(ids)]
    texts, labels = toxicity.labelled_sample(*frames(spark, docs, [(i, i % 2) for i in ids]), chars=200)
    assert labels.tolist().count(1.0) == 1 and labels.tolist().count(0.0) > 10
    assert texts[labels.tolist().index(1.0)] == ("word " * 40)
    assert toxicity.labelled_sample(*frames(spark, [(ids[0], None)], [(ids[0], 1)]))[0] == []


def test_sample_is_bounded(spark, ids):
    texts, _ = toxicity.labelled_sample(*frames(spark, [(i, "a" * 10) for i in ids], [(i, i % 2) for i in ids]), limit=7)
    assert len(texts) == 7
    texts, _ = toxicity.labelled_sample(*frames(spark, [(i, "a" * 10) for i in ids], [(i, i % 2) for i in ids]), chars=55)
    assert sum(map(len, texts)) <= 65
