"""Raw-file ingest and sinks.

* ``load_ecom_csv`` (A1): transactions CSV, columns by the header's names, optional
  cap on rows (taken in file order BEFORE the identity join), identity CSV read
  whole and left-joined on the transaction id, reference-epoch offsets turned
  into timestamps, time parts, renames, source tag.
* ``load_card_present_csv`` (A2): every CSV under a folder (recursive); with
  a cap, files are taken in sorted name order and rows in file order.
* ``write_table`` (A4) and ``write_report`` (A6).

Empty CSV fields are NULL (never NaN), so "missing" has one meaning.
"""

from __future__ import annotations

import re
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnlens.functions.scalar import (age_years, day_of_week, epoch_seconds, haversine_km,
                                      hour_of_day, offset_to_timestamp)

ECOM_SOURCE = "ieee-fraud-detection"
CARD_PRESENT_SOURCE = "sparkov"

ECOM_TXN_SCHEMA = T.StructType([
    T.StructField("TransactionID", T.LongType()), T.StructField("isFraud", T.IntegerType()),
    T.StructField("TransactionDT", T.LongType()), T.StructField("TransactionAmt", T.DoubleType()),
    T.StructField("ProductCD", T.StringType()), T.StructField("card1", T.LongType()),
    T.StructField("card4", T.StringType()), T.StructField("card6", T.StringType()),
    T.StructField("addr1", T.DoubleType()), T.StructField("addr2", T.DoubleType()),
    T.StructField("dist1", T.DoubleType()), T.StructField("P_emaildomain", T.StringType()),
    T.StructField("R_emaildomain", T.StringType()),
])
IDENTITY_SCHEMA = T.StructType([
    T.StructField("TransactionID", T.LongType()), T.StructField("DeviceType", T.StringType()),
    T.StructField("DeviceInfo", T.StringType()),
])
CARD_PRESENT_SCHEMA = T.StructType([
    T.StructField("trans_date_trans_time", T.StringType()), T.StructField("cc_num", T.StringType()),
    T.StructField("merchant", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("amt", T.DoubleType()), T.StructField("gender", T.StringType()),
    T.StructField("city", T.StringType()), T.StructField("state", T.StringType()),
    T.StructField("zip", T.StringType()), T.StructField("lat", T.DoubleType()),
    T.StructField("long", T.DoubleType()), T.StructField("city_pop", T.LongType()),
    T.StructField("job", T.StringType()), T.StructField("dob", T.StringType()),
    T.StructField("merch_lat", T.DoubleType()), T.StructField("merch_long", T.DoubleType()),
    T.StructField("is_fraud", T.IntegerType()),
])


#: Bytes read at a time while a header line has not ended.
HEADER_CHUNK = 1 << 16


def _first_line(path: str) -> list[str]:
    """Names in the header of one file (compressed ones too); unnamed and repeated
    columns are numbered."""
    import csv

    from pyarrow import fs
    if path.startswith("file:") or "://" not in path:
        store, inner = fs.LocalFileSystem(), re.sub("^file:(//)?", "", path)
    else:
        store, inner = fs.FileSystem.from_uri(quote(path, safe=":/@"))
        inner = unquote(inner)
    line = b""
    with store.open_input_stream(inner) as f:
        while b"\n" not in line:
            more = f.read(HEADER_CHUNK)
            if not more:
                break
            line += more
    names = next(csv.reader([line.split(b"\n")[0].decode("utf-8-sig").rstrip("\r")]), [])
    return [n if n and n not in names[:i] else f"_c{i}" for i, n in enumerate(names)]


def _headers(spark: SparkSession, path: str, recursive: bool) -> dict[tuple[str, ...], list[str]]:
    """Files by their header line, files in name order, from one job however many
    files there are: tasks read the first line of their files. What comes back is the
    paths, which the CSV reader takes as a list."""
    r = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv*" if recursive else "*")
    if recursive:
        r = r.option("recursiveFileLookup", True)

    def heads(batches):
        import pyarrow as pa
        for b in batches:
            paths = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([_first_line(p) for p in paths], pa.list_(pa.string()))], ["path", "names"])

    out: dict[tuple[str, ...], list[str]] = {}
    rows = r.load(path).where("length > 0").select("path").mapInArrow(heads, "path string, names array<string>").collect()
    for row in sorted(rows, key=lambda r: r["path"]):
        out.setdefault(tuple(row["names"]), []).append(row["path"])
    return out


def _csv(spark: SparkSession, path: str, schema: T.StructType, recursive: bool = False) -> DataFrame:
    """The columns of ``schema``, found by the names in each file's header: files
    may order them differently and hold others, which are not kept. A missing one
    raises; a value that cannot be read as its type is null. ``_at`` is the row's
    place (file, split, offset)."""
    found = _headers(spark, path, recursive)
    if not found:
        raise FileNotFoundError(f"no CSV files at {path}")
    parts = []
    for columns, files in found.items():
        absent = [f.name for f in schema if f.name not in columns]
        if absent:
            raise ValueError(f"{files[0]}: missing column(s) {', '.join(absent)}")
        as_read = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        raw = (spark.read.schema(as_read).option("header", True).option("mode", "PERMISSIVE")
               .option("nullValue", "").option("emptyValue", None).csv(files))
        place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                         F.monotonically_increasing_id().alias("pos"))
        parts.append(raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema], place.alias("_at")))
    df = parts[0]
    for one in parts[1:]:
        df = df.unionByName(one)
    return df


def _capped(df: DataFrame, limit: int | None) -> DataFrame:
    """First ``limit`` rows in file order: files by name, splits by byte
    offset, rows by their order inside the split (the id grows with it). Only
    when a cap is asked for is an order imposed; the cap is a bounded top-n."""
    return df.drop("_at") if limit is None else df.orderBy("_at").limit(limit).drop("_at")


def load_ecom_csv(spark: SparkSession, txn_path: str, identity_path: str,
                  limit: int | None = None) -> DataFrame:
    tx = _capped(_csv(spark, txn_path, ECOM_TXN_SCHEMA), limit)
    return ecom_rows(tx, _csv(spark, identity_path, IDENTITY_SCHEMA).drop("_at"))


def ecom_rows(tx: DataFrame, ident: DataFrame) -> DataFrame:
    """Transactions with the kept columns, joined to identity and with times."""
    tx = tx.select(*ECOM_TXN_SCHEMA.fieldNames())
    j = tx.join(ident.select(*IDENTITY_SCHEMA.fieldNames()), on="TransactionID", how="left")
    ts = offset_to_timestamp(F.col("TransactionDT"))
    return (j.withColumn("timestamp", ts).withColumn("ts_sec", epoch_seconds(ts))
            .withColumn("hour_of_day", hour_of_day(ts)).withColumn("day_of_week", day_of_week(ts))
            .withColumnRenamed("isFraud", "is_fraud")
            .withColumn("dataset_source", F.lit(ECOM_SOURCE)))


def load_card_present_csv(spark: SparkSession, raw_dir: str, limit: int | None = None) -> DataFrame:
    return card_present_rows(_capped(_csv(spark, raw_dir, CARD_PRESENT_SCHEMA, recursive=True), limit))


def card_present_rows(df: DataFrame) -> DataFrame:
    """Card-present rows with the kept columns, times, age and distance."""
    df = df.select(*CARD_PRESENT_SCHEMA.fieldNames())
    ts = F.to_timestamp_ntz("trans_date_trans_time")
    dob = F.to_date("dob")
    return (df.withColumn("timestamp", ts)
            .withColumn("hour_of_day", hour_of_day(ts)).withColumn("day_of_week", day_of_week(ts))
            .withColumn("age_at_txn", age_years(ts, dob))
            .withColumn("geo_distance_km", haversine_km("lat", "long", "merch_lat", "merch_long"))
            .withColumn("ts_sec", epoch_seconds(ts))
            .withColumn("dataset_source", F.lit(CARD_PRESENT_SOURCE)))


def write_table(df: DataFrame, path: str, partition_by: str | None = "train_split",
                mode: str = "overwrite") -> None:
    """Parquet sink; partitioned by split so a split filter prunes files."""
    w = df.write.mode(mode)
    if partition_by and partition_by in df.columns:
        w = w.partitionBy(partition_by)
    w.parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """Small metric tables as JSON (one file)."""
    df.coalesce(1).write.mode("overwrite").json(path)
