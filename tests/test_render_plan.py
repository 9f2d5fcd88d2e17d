"""Rendering stays out of whole-stage code, and what counts as missing."""

import pytest
from pyspark.sql import functions as F

from txnlens.functions import render as R
from txnlens.functions.scalar import MISSING_TEXT, is_missing


@pytest.mark.parametrize("source", ["sparkov", "ieee-fraud-detection"])
def test_rendering_is_compiled_in_parts(spark, source):
    df = spark.range(5).select(F.col("id").alias("txn_id"), (F.col("id") * 1000.5).alias("amt"), (F.col("id") * 1000.5).alias("TransactionAmt"),
                               F.col("id").alias("hour_of_day"), F.lit("visa").alias("card4"), F.col("id").alias("velocity_1h"))
    out = df.select("txn_id", R.render(df, source).alias("rendered"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.startswith("Project")  # "*(1) Project" is one method for all parts
    last = out.where("txn_id = 4").first()["rendered"]
    assert "Amount: $4002.00" in last and "Time: 04:xx (overnight)" in last and "Card velocity: 4 txn in past 1h" in last


def test_missing_text_and_numbers(spark):
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace() and c not in range(0x1c, 0x20)]
    rows = [(None, None)] + [(a + t.upper() + b, float("nan")) for t in MISSING_TEXT for a in ["", *spaces] for b in ["", " \n"]]
    got = spark.createDataFrame(rows, "t string, x double").agg(F.every(is_missing("t")).alias("t"), F.every(is_missing("x", "number")).alias("x")).first()
    assert got["t"] and got["x"]
    rows = [("n one", 0.0), ("​nan", -1.0), ("missing.", float("inf"))]
    got = spark.createDataFrame(rows, "t string, x double").agg(F.bool_or(is_missing("t")).alias("t"), F.bool_or(is_missing("x", "number")).alias("x")).first()
    assert not got["t"] and not got["x"]
