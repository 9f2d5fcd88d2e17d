"""Readers for the parquet tables and the stand-in views built on them.

The test tables are not card data, so each view maps one of them onto the
model the operators expect (SURVEY 7.1). Every view is a lazy DataFrame over
the parquet scan, so column pruning and filters still reach the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlens.functions.scalar import day_of_week, epoch_seconds, hour_of_day

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def unix_sec(col: str) -> F.Column:
    """Whole seconds since 1970. Parquet timestamps load as TIMESTAMP_NTZ
    (wall clock): read as UTC whatever the session time zone."""
    return epoch_seconds(F.col(col))


def with_time_parts(df: DataFrame, ts: str = "ts") -> DataFrame:
    """hour_of_day 0-23 and day_of_week with Monday = 0 (Spark ``weekday``),
    from the wall-clock time."""
    return (df.withColumn("hour_of_day", hour_of_day(ts))
            .withColumn("day_of_week", day_of_week(ts)))


# --- stand-in views ---------------------------------------------------------

def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card-present transactions from ``events``: user = card, value = amount,
    event type = merchant category, an error event = fraud."""
    e = read_table(spark, sf_dir, "events")
    df = e.select(
        F.col("event_id").alias("txn_id"),
        F.col("user_id").alias("card_id"),
        F.col("ts").alias("ts"),
        unix_sec("ts").alias("ts_sec"),
        F.col("value").alias("amt"),
        F.concat(F.lit("merchant_"), F.get_json_object("props", "$.k")).alias("merchant"),
        F.col("event_type").alias("category"),
        (F.col("event_type") == "error").cast("int").alias("is_fraud"))
    return with_time_parts(df)


def txn_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with same-second ties per card, from ``orders``."""
    o = read_table(spark, sf_dir, "orders")
    df = o.select(
        F.col("o_orderkey").alias("txn_id"),
        F.col("o_custkey").alias("card_id"),
        F.col("o_orderdate").alias("ts"),
        unix_sec("o_orderdate").alias("ts_sec"),
        F.col("o_totalprice").alias("amt"),
        (F.col("o_orderstatus") == "P").cast("int").alias("is_fraud"))
    return with_time_parts(df)


def ecom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-commerce transactions: ``orders`` left-joined to ``customer`` (the
    identity side table) and ``nation``. Email domains, device and geography
    are derived from the keys so every rendering branch is reachable."""
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer")
    n = read_table(spark, sf_dir, "nation")
    # Identity and nation sides are dimension tables (one row per key): the
    # join is an equi-join the optimizer may broadcast when AQE sees them small.
    j = (o.join(c, o.o_custkey == c.c_custkey, "left")
         .join(n, F.col("c_nationkey") == n.n_nationkey, "left"))
    ck, ok = F.col("o_custkey"), F.col("o_orderkey")
    p_email = (F.when(F.pmod(ck, 6) == 0, "gmail.com").when(F.pmod(ck, 6) == 1, "ProtonMail.com")
               .when(F.pmod(ck, 6) == 2, "acme.com").when(F.pmod(ck, 6) == 4, "yahoo.fr")
               .when(F.pmod(ck, 6) == 5, "Hotmail.com"))
    r_email = (F.when(F.pmod(ok, 4) == 0, "gmail.com").when(F.pmod(ok, 4) == 2, "acme.com")
               .when(F.pmod(ok, 4) == 3, "cuvox.de"))
    df = j.select(
        ok.alias("txn_id"), ck.alias("card_id"),
        F.col("o_orderdate").alias("ts"),
        unix_sec("o_orderdate").alias("ts_sec"),
        F.col("o_totalprice").alias("TransactionAmt"),
        F.substring("o_orderpriority", 3, 1).alias("ProductCD"),
        F.lower("c_mktsegment").alias("card4"),
        F.when(F.col("o_orderstatus") == "F", "debit")
         .when(F.col("o_orderstatus") == "O", "credit").alias("card6"),
        p_email.alias("P_emaildomain"), r_email.alias("R_emaildomain"),
        F.when(F.pmod(ok, 3) == 0, "desktop").when(F.pmod(ok, 3) == 1, "mobile").alias("DeviceType"),
        F.when(F.pmod(ok, 5) == 0, "iOS").when(F.pmod(ok, 5) == 1, "Windows")
         .when(F.pmod(ok, 5) == 2, "missing").alias("DeviceInfo"),
        F.col("c_acctbal").cast("double").alias("dist1"),
        F.col("c_nationkey").cast("double").alias("addr1"),
        F.col("n_regionkey").cast("double").alias("addr2"),
        (F.col("o_orderstatus") == "P").cast("int").alias("is_fraud"))
    return with_time_parts(df)


def act(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activation vectors from ``embeddings``: a score that hits the exact bin
    edges and a rare positive label (class 0)."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("row_idx"),
        F.col("embedding").alias("activation_vector"),
        (F.pmod(F.col("vec_id") * 37, F.lit(101)) / F.lit(100.0)).alias("fraud_score"),
        (F.col("label") == 0).cast("int").alias("label"),
        F.col("label").alias("class_id"))


def recon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold and reconstructed vectors: ``0.8 * e_i + 0.2 * e_(i+1)`` where
    ``i+1`` is the next vector id; a vector without a successor is its own."""
    a = act(spark, sf_dir)
    nxt = a.select((F.col("row_idx") - 1).alias("row_idx"),
                   F.col("activation_vector").alias("_next"))
    j = a.join(nxt, "row_idx", "left")
    pred = F.zip_with("activation_vector", F.coalesce("_next", "activation_vector"),
                      lambda g, h: F.lit(0.8) * g.cast("double") + F.lit(0.2) * h.cast("double"))
    return j.select("row_idx", "activation_vector", pred.alias("pred_vector"),
                    "fraud_score", "label")


def with_geo(df: DataFrame) -> DataFrame:
    """Home / merchant coordinates and a birth date derived from the card and
    transaction keys, for the card-present distance and age features."""
    card, tid = F.col("card_id"), F.col("txn_id")
    lat = F.lit(25.25) + F.pmod(card * 7, F.lit(23)).cast("double")
    lon = F.lit(-119.5) + F.pmod(card * 11, F.lit(50)).cast("double")
    return (df.withColumn("lat", lat).withColumn("long", lon)
            .withColumn("merch_lat", lat + (F.pmod(tid, F.lit(21)) - 10).cast("double") / 4.0)
            .withColumn("merch_long", lon + (F.pmod(tid * 3, F.lit(41)) - 20).cast("double") / 2.0)
            .withColumn("dob", F.date_add(F.to_date(F.lit("1950-01-01")),
                                          F.pmod(card * 97, F.lit(18000)).cast("int"))))
