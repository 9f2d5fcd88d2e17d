import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from txnlens.sources import ingest as I
from txnlens.sources import tables as T


def test_ecom_csv_ingest(spark, tmp_path):
    tx = tmp_path / "train_transaction.csv"
    tx.write_text("TransactionID,isFraud,TransactionDT,TransactionAmt,ProductCD,card1,card4,card6,"
                  "addr1,addr2,dist1,P_emaildomain,R_emaildomain\n"
                  "1,0,86400,10.5,W,7,visa,debit,1.0,87.0,,gmail.com,\n"
                  "2,1,90000,20.0,H,7,visa,credit,,,3.0,,\n"
                  "3,0,100000,30.0,C,8,amex,debit,,,,,\n")
    ident = tmp_path / "train_identity.csv"
    ident.write_text("TransactionID,DeviceType,DeviceInfo\n1,mobile,iOS\n3,desktop,\n")
    df = I.load_ecom_csv(spark, str(tx), str(ident), limit=2)
    rows = {r.TransactionID: r for r in df.collect()}
    assert sorted(rows) == [1, 2]                    # cap applied before the join
    assert rows[1].DeviceType == "mobile" and rows[2].DeviceType is None
    assert rows[1].R_emaildomain is None and rows[1].dist1 is None   # empty -> NULL
    assert str(rows[1].timestamp) == "2017-12-01 00:00:00"
    assert (rows[1].hour_of_day, rows[1].day_of_week) == (0, 4)   # a Friday
    assert rows[2].is_fraud == 1 and rows[1].dataset_source == "ieee-fraud-detection"


def test_card_present_multi_file(spark, tmp_path):
    hdr = ("trans_date_trans_time,cc_num,merchant,category,amt,gender,city,state,zip,lat,long,"
           "city_pop,job,dob,merch_lat,merch_long,is_fraud\n")
    d = tmp_path / "raw" / "sub"
    d.mkdir(parents=True)
    (d / "b.csv").write_text(hdr + "2020-01-02 10:00:00,1,m2,travel,2.0,F,c,s,1,40.0,-70.0,5,j,"
                             "1990-01-02,40.1,-70.1,0\n")
    (tmp_path / "raw" / "a.csv").write_text(
        hdr + "2020-01-01 10:00:00,1,m1,misc_net,1.0,F,c,s,1,40.0,-70.0,5,j,1990-01-01,41.0,-70.0,1\n")
    df = I.load_card_present_csv(spark, str(tmp_path / "raw"))
    assert df.count() == 2
    r = df.where(F.col("merchant") == "m1").first()
    assert abs(r.geo_distance_km - 111.19) < 0.1
    assert abs(r.age_at_txn - 30.0) < 0.01


def test_columns_are_found_by_name(spark, tmp_path):
    """Other orders and more columns, as the public files have them."""
    tx = tmp_path / "t.csv"
    tx.write_text("TransactionID,isFraud,TransactionDT,TransactionAmt,ProductCD,card1,card2,card3,card4,card5,card6,"
                  "addr1,addr2,dist1,dist2,P_emaildomain,R_emaildomain,C1\n"
                  "9,0,86400,10.5,W,13926,404,150,discover,142,credit,315,87,19,,a.example,b.example,x\n")
    ident = tmp_path / "i.csv"
    ident.write_text("TransactionID,id_01,DeviceInfo,DeviceType\n9,-5,Windows,desktop\n")
    r = I.load_ecom_csv(spark, str(tx), str(ident)).first()
    assert (r.card1, r.card4, r.card6, r.addr1, r.addr2, r.dist1) == (13926, "discover", "credit", 315.0, 87.0, 19.0)
    assert (r.P_emaildomain, r.R_emaildomain, r.DeviceType, r.DeviceInfo) == ("a.example", "b.example", "desktop", "Windows")
    assert "card2" not in r.asDict() and "C1" not in r.asDict()
    raw = tmp_path / "cp"
    raw.mkdir()
    (raw / "one.csv").write_text(
        ",trans_date_trans_time,cc_num,merchant,category,amt,first,last,gender,street,city,state,zip,lat,long,city_pop,job,dob,"
        "trans_num,unix_time,merch_lat,merch_long,is_fraud\n"
        "0,2019-01-01 00:00:18,270318,m,misc_net,4.97,J,B,F,5 Cove,M,NC,28654,36.0,-81.0,3495,j,1988-03-09,ab,1325376018,36.0,-82.0,0\n")
    (raw / "two.csv").write_text(
        "is_fraud,trans_date_trans_time,cc_num,merchant,category,amt,gender,city,state,zip,lat,long,city_pop,job,dob,merch_lat,merch_long\n"
        "1,2019-01-02 00:00:18,4,n,home,bad,F,M,NC,1,36.0,-81.0,3495,j,1988-03-09,36.0,-81.0\n")
    got = {r.merchant: r for r in I.load_card_present_csv(spark, str(raw)).collect()}
    assert got["m"].cc_num == "270318" and got["m"].amt == 4.97 and got["m"].ts_sec is not None
    assert got["n"].is_fraud == 1 and got["n"].amt is None


def test_missing_column_raises(spark, tmp_path):
    ident = tmp_path / "i.csv"
    ident.write_text("TransactionID,DeviceType\n1,mobile\n")
    with pytest.raises(ValueError, match="DeviceInfo"):
        I._csv(spark, str(ident), I.IDENTITY_SCHEMA)


def test_sinks_roundtrip(spark, tmp_path):
    df = T.txn(spark, SF001).withColumn("train_split", F.lit("train"))
    out = str(tmp_path / "tbl")
    I.write_table(df, out)
    back = spark.read.parquet(out)
    assert back.count() == df.count()
    assert os.path.isdir(os.path.join(out, "train_split=train"))
    rep = str(tmp_path / "rep")
    I.write_report(spark.createDataFrame([("auc", 0.5)], "metric string, value double"), rep)
    files = [f for f in os.listdir(rep) if f.endswith(".json")]
    assert json.loads(open(os.path.join(rep, files[0])).read()) == {"metric": "auc", "value": 0.5}


def test_cap_across_files_in_name_order(spark, tmp_path):
    hdr = ("trans_date_trans_time,cc_num,merchant,category,amt,gender,city,state,zip,lat,long,"
           "city_pop,job,dob,merch_lat,merch_long,is_fraud\n")
    row = "2020-01-0{d} 10:00:00,1,{m},travel,1.0,F,c,s,1,40.0,-70.0,5,j,1990-01-01,40.0,-70.0,0\n"
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "b.csv").write_text(hdr + row.format(d=3, m="b1") + row.format(d=4, m="b2"))
    (raw / "a.csv").write_text(hdr + row.format(d=1, m="a1") + row.format(d=2, m="a2"))
    got = sorted(r.merchant for r in I.load_card_present_csv(spark, str(raw), limit=3).collect())
    assert got == ["a1", "a2", "b1"]


def test_journal_append_and_read(spark, tmp_path):
    from txnlens.streaming.journal import append_records, latest_records, read_journal
    path = str(tmp_path / "journal")
    schema = "row_idx long, summary string, features_json string, fraud_score double, label int, seq long"
    append_records(spark.createDataFrame([(1, "- a", None, 0.5, 0, 0), (2, "- b", None, 0.1, 0, 0)], schema), path)
    append_records(spark.createDataFrame([(1, "- a2", None, 0.5, 0, 1)], schema), path)
    with open(os.path.join(path, "zz-garbage.json"), "w") as f:
        f.write("not json\n\n")
    recs = read_journal(spark, path)
    assert recs.count() == 3
    last = {r.row_idx: r.summary for r in latest_records(recs).collect()}
    assert last == {1: "- a2", 2: "- b"}


def test_journal_without_seq(spark, tmp_path):
    from txnlens.streaming.journal import latest_records, read_journal
    (tmp_path / "a.jsonl").write_text('{"row_idx": 1, "summary": "old"}\n{"row_idx": 1, "summary": "new"}\n{"row_idx": 2, "summary": "x"}\n')
    last = {r.row_idx: r.summary for r in latest_records(read_journal(spark, str(tmp_path))).collect()}
    assert last == {1: "new", 2: "x"}


def test_split_partition_pruning(spark, tmp_path):
    from txnlens.operators.ordering import time_split
    out = str(tmp_path / "split")
    I.write_table(time_split(T.txn(spark, SF001)), out)
    back = spark.read.parquet(out).where(F.col("train_split") == "val")
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(train_split" in plan and "val" in plan
    assert back.count() == 100
