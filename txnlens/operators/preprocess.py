"""Preprocessor fit / apply as parameter tables.

fit -> ``cat_vocab(col, value, id)`` and ``num_stats(col, median, mean, std,
scale)``; both are ordinary DataFrames that can be written as parquet (no
pickled objects).

* Categoricals: null -> ``__missing__``; a column with more than ``cap``
  distinct values keeps its ``cap`` most frequent values (ties by value) and
  maps the rest to ``__rare__``; the vocabulary is the sorted distinct values
  plus ``__missing__``, ``__unknown__``, ``__rare__`` and ids are positions.
* Numerics: clip -> interpolated median -> fill -> mean and population std of
  the filled column (scale 1 when the std is 0).

The vocabulary has at most ``cap + 3`` entries per column, so apply turns it
into a literal map (a proven size bound) instead of a join per column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnlens.functions.scalar import NUMERIC_CLIP, clip_named
from txnlens.operators.metrics import exact_quantiles
from txnlens.operators.ordering import (SELECT_BAND_MAX, SelectionFallback, group_value_stats,
                                        rank_table, select_quantiles)

# Fixed values that must equal the reference.
CAT_VOCAB_CAP = 200
MISSING, UNKNOWN, RARE = "__missing__", "__unknown__", "__rare__"
SENTINELS = [MISSING, UNKNOWN, RARE]


def _long_cats(df: DataFrame, cats: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("col"),
                               F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("value"))
                      for c in cats])
    return df.select(F.explode(pairs).alias("p")).select("p.col", "p.value")


def fit_cat_vocab(df: DataFrame, cats: list[str], cap: int = CAT_VOCAB_CAP) -> DataFrame:
    counts = _long_cats(df, cats).groupBy("col", "value").agg(F.count(F.lit(1)).alias("n"))
    n_unique = counts.groupBy("col").agg(F.count(F.lit(1)).alias("n_unique"))
    # Top values per column by (count desc, value asc): a distributed rank, so a
    # column with very many distinct values is not ranked in one task.
    ranked = rank_table(counts.withColumn("neg_n", -F.col("n")), ["col", "neg_n", "value"],
                        rank_col="_r")
    start = ranked.groupBy("col").agg(F.min("_r").alias("_s"))
    top = (ranked.join(start, "col").join(n_unique, "col")
           .where((F.col("n_unique") <= cap) | (F.col("_r") - F.col("_s") < cap))
           .select("col", "value", (F.col("n_unique") > cap).alias("capped")))
    capped = n_unique.where(F.col("n_unique") > cap).select("col", F.lit(RARE).alias("value"))
    sent = n_unique.select("col", F.explode(F.array(*[F.lit(s) for s in SENTINELS])).alias("value"))
    vocab = top.select("col", "value").unionByName(capped).unionByName(sent).distinct()
    # <= cap + 3 rows per column: a window per column is bounded.
    w = Window.partitionBy("col").orderBy("value")
    flags = n_unique.select("col", (F.col("n_unique") > cap).alias("capped"))
    topset = top.select("col", "value", F.lit(True).alias("in_top"))
    return (vocab.join(flags, "col").join(topset, ["col", "value"], "left")
            .select("col", "value", (F.row_number().over(w) - 1).cast("int").alias("id"),
                    "capped", F.coalesce("in_top", F.lit(False)).alias("in_top")))


def _long_nums(df: DataFrame, nums: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), clip_named(c).alias("x")) for c in nums])
    return df.select(F.explode(pairs).alias("p")).select("p.col", "p.x")


def fit_num_stats(df: DataFrame, nums: list[str]) -> DataFrame:
    long = _long_nums(df, nums)
    spark = df.sparkSession
    stats = group_value_stats(long, "col", "x")          # one row per column
    try:
        if sum(v[0] for v in stats.values()) <= SELECT_BAND_MAX:
            raise SelectionFallback("small: one exact rank is cheaper")
        # exact interpolated medians by histogram selection: no sort of the values
        got = select_quantiles(long, "col", "x", {"median": 0.5}, stats=stats)
        med = spark.createDataFrame([(c, got.get(c, {}).get("median")) for c in nums],
                                    "col string, median double")
    except SelectionFallback:
        med = exact_quantiles(long.where(~F.isnan("x")), "x", {"median": 0.5}, by=["col"])
        # Columns that are all null still get a row (median null -> fill is null).
        med = long.select("col").distinct().join(med, "col", "left")
    filled = long.join(F.broadcast(med), "col").withColumn(
        "f", F.when(F.col("x").isNull() | F.isnan("x"), F.col("median")).otherwise(F.col("x")))
    st = filled.groupBy("col").agg(F.avg("f").alias("mean"), F.stddev_pop("f").alias("std"))
    return med.join(st, "col").withColumn(
        "scale", F.when((F.col("std") == 0) | F.col("std").isNull(), F.lit(1.0))
        .otherwise(F.col("std")))


def fit_preprocessor(df: DataFrame, cats: list[str], nums: list[str],
                     cap: int = CAT_VOCAB_CAP) -> tuple[DataFrame, DataFrame]:
    return fit_cat_vocab(df, cats, cap), fit_num_stats(df, nums)


def apply_preprocessor(df: DataFrame, cat_vocab: DataFrame, num_stats: DataFrame,
                       cat_suffix: str = "_id", num_suffix: str = "_scaled") -> DataFrame:
    """Categorical ids and scaled float32 numerics, as new columns."""
    vocab = cat_vocab.collect()          # bounded: <= cap + 3 rows per column
    stats = num_stats.collect()          # one row per numeric column
    by_col: dict[str, dict] = {}
    capped: dict[str, bool] = {}
    tops: dict[str, list] = {}
    for r in vocab:
        by_col.setdefault(r["col"], {})[r["value"]] = r["id"]
        capped[r["col"]] = bool(r["capped"])
        if r["in_top"]:
            tops.setdefault(r["col"], []).append(r["value"])
    out = df
    spark = df.sparkSession
    for c, ids in by_col.items():
        # the value -> id table has at most cap + 3 rows: a hash lookup by broadcast
        known = set(tops.get(c, [])) if capped[c] else set(ids)
        table = spark.createDataFrame([(v, ids[v]) for v in sorted(known)], "_value string, _id int")
        value = F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
        names = out.columns
        out = (out.withColumn("_value", value).join(F.broadcast(table), "_value", "left")
               .select(*names, F.coalesce("_id", F.lit(ids[RARE if capped[c] else UNKNOWN])).alias(c + cat_suffix)))
    for r in stats:
        c = r["col"]
        x = clip_named(c)
        x = F.when(x.isNull() | F.isnan(x), F.lit(r["median"])).otherwise(x)
        # float32 like the reference: cast, centre, cast, scale, cast.
        f32 = x.cast("float").cast("double")
        centred = (f32 - F.lit(r["mean"])).cast("float").cast("double")
        out = out.withColumn(c + num_suffix, (centred / F.lit(r["scale"])).cast("float"))
    return out


def clip_ranges() -> dict:
    return dict(NUMERIC_CLIP)
