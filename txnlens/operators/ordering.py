"""Exact global ordering without a single-task window.

``rank_table`` gives every row its 0-based position in a total order. Rows are
range-partitioned on the order keys and sorted inside each partition; a row's
position inside its partition comes from ``monotonically_increasing_id`` taken
right after that sort (it encodes partition index and offset), and the
partition offsets come from per-partition counts -- a table with one row per
partition, the only thing that is ever put in one place.

Most users of an order need only a few positions (split boundaries, the n-th
hash of a sample, quantile positions): they rank the narrow key projection,
collect or filter those positions, and never join ranks back to wide rows.
``global_rank`` (ranks joined back) is for when every row needs its rank.
``prefix_sums`` gives running sums the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PART_SHIFT = 33  # monotonically_increasing_id = partition << 33 | offset

# Narrow (key) rows per range partition when the row count is known.
ROWS_PER_RANGE_PARTITION = 1_000_000


def shared_exchange(df: DataFrame) -> DataFrame:
    """A range-partitioned table whose partition ids are read by two
    consumers. Spark's range partitioner seeds its sampling with the RDD id,
    so two separately computed exchanges choose different bounds even on the
    same input: the consumers must share ONE exchange. Spark reuses identical
    exchanges; if exchange reuse is switched off, the partitioned table (with
    its partition ids as columns) is checkpointed instead."""
    if df.sparkSession.conf.get("spark.sql.exchange.reuse", "true").lower() == "false":
        from txnlens.session import cut_lineage
        return cut_lineage(df)
    return df


def partitions_for(spark, rows: int | None) -> int:
    """Range partitions for a narrow table: by its row count where that is known,
    else the configured shuffle partitions."""
    if rows is None:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-rows // ROWS_PER_RANGE_PARTITION))


def global_rank(df: DataFrame, order_cols: list[str], rank_col: str = "_rank",
                total_col: str | None = None, num_partitions: int | None = None) -> DataFrame:
    """Add ``rank_col`` = 0-based position in ``order_cols`` order (which must
    be a total order, e.g. end with a unique id); optionally ``total_col`` =
    the row count.

    The rank is computed on the projection of ``order_cols`` alone, so the
    per-partition counts and the per-row offsets read one shared range
    exchange (see :func:`shared_exchange`). The ranks are then joined back on
    the order columns."""
    ranks = rank_table(df, order_cols, rank_col, total_col, num_partitions)
    return df.join(ranks, on=list(order_cols), how="inner")


def rank_table(df: DataFrame, order_cols: list[str], rank_col: str = "_rank",
               total_col: str | None = None, num_partitions: int | None = None,
               nullable: list[str] = ()) -> DataFrame:
    """``(order_cols..., rank_col[, total_col])`` for every row of ``df`` without
    nulls in the order columns; a null in a ``nullable`` one sorts first."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Both consumers (per-partition counts, per-row offsets) must read ONE
    # range exchange: two separately computed exchanges pick different bounds
    # (the sampler is seeded by the RDD id). The explicit null filter keeps the
    # two subplans identical (the join would otherwise push inferred filters
    # into one of them only), so the exchange is reused; a test asserts it.
    keys = df.select(*order_cols)
    for c in order_cols:
        if c not in nullable:
            keys = keys.where(F.col(c).isNotNull())
    ranked = (keys
              .repartitionByRange(n, *order_cols)
              .sortWithinPartitions(*order_cols)
              .withColumn("_mid", F.monotonically_increasing_id())
              .withColumn("_rp", F.shiftright("_mid", _PART_SHIFT)))
    ranked = shared_exchange(ranked)
    counts = ranked.groupBy("_rp").agg(F.count(F.lit(1)).alias("_rn"))
    # One row per partition: a global window over it is bounded.
    w = Window.orderBy("_rp")
    cols = [F.col("_rp"),
            F.coalesce(F.sum("_rn").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                       F.lit(0)).alias("_off")]
    if total_col:
        cols.append(F.sum("_rn").over(Window.partitionBy()).alias(total_col))
    offsets = counts.select(*cols)
    return (ranked.join(F.broadcast(offsets), on="_rp", how="inner")
            .withColumn(rank_col, F.col("_off") + F.col("_mid")
                        - F.shiftleft(F.col("_rp"), _PART_SHIFT))
            .drop("_mid", "_rp", "_off"))


def time_split(df: DataFrame, ts: str = "ts_sec", key: str = "txn_id",
               val_frac: float = 0.1, test_frac: float = 0.1,
               split_col: str = "train_split") -> DataFrame:
    """Ordinal time split: in ``(ts, key)`` order the first
    ``int(n * (1 - val - test))`` rows are train, up to ``int(n * (1 - test))``
    val, the rest test. Equal timestamps may straddle a boundary.

    Only the two boundary rows matter, so the narrow ``(ts, key)`` projection
    is ranked, the two boundary keys (a proven bound: 2 rows) are collected,
    and every row is labelled by comparing its key with them: the wide table
    is never shuffled or joined. Rows with a null time or key sort last."""
    # n counts every row (a missing time sorts last), and the two positions
    # are computed exactly as the reference does, in Python integers.
    n_rows = df.count()
    train_end, val_end = split_sizes(n_rows, val_frac, test_frac)
    int_keys = all(isinstance(df.schema[c].dataType, (T.LongType, T.IntegerType, T.ShortType))
                   for c in (ts, key))
    if int_keys:
        # exact selection by histogram passes: no row-level shuffle at all
        marks = select_positions(df, [ts, key], [train_end, val_end])
    else:
        r = rank_table(df, [ts, key], rank_col="_pos",
                       num_partitions=partitions_for(df.sparkSession, n_rows))
        marks = {int(m["_pos"]): (m[ts], m[key]) for m in
                 r.where(F.col("_pos").isin(train_end, val_end)).select("_pos", ts, key).collect()}
    b_train, b_val = marks.get(train_end), marks.get(val_end)

    def before(b) -> Column:
        if b is None:                       # boundary past the end: every row is before it
            return F.lit(True)
        t, k = F.col(ts), F.col(key)
        return (t < F.lit(b[0])) | ((t == F.lit(b[0])) & (k < F.lit(b[1])))

    label = (F.when(before(b_train), F.lit("train"))
             .when(before(b_val), F.lit("val")).otherwise(F.lit("test")))
    return df.withColumn(split_col, F.coalesce(label, F.lit("test")))


def split_sizes(n: int, val_frac: float = 0.1, test_frac: float = 0.1) -> tuple[int, int]:
    """(train_end, val_end) for ``n`` rows, same arithmetic as ``time_split``."""
    return int(n * (1.0 - val_frac - test_frac)), int(n * (1.0 - test_frac))


def prefix_sums(df: DataFrame, order_cols: list[str], value_cols: list[str],
                prefix: str = "cum_", num_partitions: int | None = None,
                totals: bool = False) -> DataFrame:
    """Inclusive running sums of ``value_cols`` in ``order_cols`` order (a
    total order) across the whole table; output is ``order_cols``,
    ``value_cols`` and the sums. Range partitions compute local running sums;
    their totals (one row per partition) give the offsets, broadcast.
    ``totals`` also attaches the grand totals as ``tot_<col>``.

    Both branches read the same narrow projection, so they share ONE range
    exchange (the partition ids of the running sums and of the totals must
    come from the same bounds)."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(*order_cols, *[F.col(c).cast("double").alias(c) for c in value_cols])
    for c in order_cols:
        keys = keys.where(F.col(c).isNotNull())
    sorted_keys = keys.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols).withColumn("_rp", F.spark_partition_id())

    def running(batches):
        import numpy as np
        import pyarrow as pa
        carry = dict.fromkeys(value_cols, 0.0)
        for b in batches:
            sums = []
            for c in value_cols:
                own = np.cumsum(np.nan_to_num(b.column(c).to_numpy(zero_copy_only=False))) + carry[c]
                carry[c] = float(own[-1]) if len(own) else carry[c]
                sums.append(pa.array(own))
            yield pa.RecordBatch.from_arrays([*b.columns, *sums], [*b.schema.names, *[f"_l_{c}" for c in value_cols]])

    # the sums run through each sorted range as it lies: no exchange after the range one
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_keys.schema] + [f"`_l_{c}` double" for c in value_cols]
    local = shared_exchange(sorted_keys.mapInArrow(running, ", ".join(kinds)))
    part = local.groupBy("_rp").agg(*[F.sum(c).alias(f"_t_{c}") for c in value_cols])
    # one row per partition: global windows here are bounded
    prev = Window.orderBy("_rp").rowsBetween(Window.unboundedPreceding, -1)
    cols = [F.coalesce(F.sum(f"_t_{c}").over(prev), F.lit(0.0)).alias(f"_o_{c}") for c in value_cols]
    if totals:
        cols += [F.sum(f"_t_{c}").over(Window.partitionBy()).alias(f"tot_{c}") for c in value_cols]
    offsets = part.select("_rp", *cols)
    out = local.join(F.broadcast(offsets), on="_rp", how="inner")
    for c in value_cols:
        out = out.withColumn(prefix + c, F.col(f"_l_{c}") + F.col(f"_o_{c}"))
    return out.drop("_rp", *[f"_l_{c}" for c in value_cols], *[f"_o_{c}" for c in value_cols])


# Exact selection: a band of at most this many keys is ranked directly.
SELECT_BAND_MAX = 2_000_000
SELECT_BUCKETS = 4096


def select_positions(df: DataFrame, cols: list[str], positions: list[int],
                     band_max: int = SELECT_BAND_MAX, buckets: int = SELECT_BUCKETS) -> dict:
    """Keys at given 0-based positions of the ``cols`` order (integral
    columns, non-null rows), without sorting the table.

    Histogram selection: each pass is a filtered scan of the key columns and
    a partial aggregate into at most ``buckets`` equal-width buckets (the only
    thing collected); the bucket holding the target narrows the value range.
    When one value of a column remains (e.g. a timestamp holding a third of
    the rows) the next column is refined within it. A band of at most
    ``band_max`` keys is ranked exactly with ``rank_table``. Returns
    ``{position: tuple of key values or None}``."""
    base = df.select(*cols)
    for c in cols:
        base = base.where(F.col(c).isNotNull())
    st = base.agg(F.count(F.lit(1)).alias("n"), F.min(cols[0]).alias("lo"),
                  F.max(cols[0]).alias("hi")).first()
    n = int(st["n"])
    out: dict = {}
    want = [p for p in positions if 0 <= p < n]
    for p in positions:
        if p not in want:
            out[p] = None
    if want and n <= band_max:
        # small table: one exact rank answers every position
        r = rank_table(base, cols, rank_col="_r", num_partitions=partitions_for(df.sparkSession, n))
        for m in r.where(F.col("_r").isin(want)).collect():     # len(positions) rows
            out[int(m["_r"])] = tuple(m[c] for c in cols)
        return out
    for p in want:
        fixed: list = []
        below = 0
        band = base
        size = n
        i = 0
        lo, hi = int(st["lo"]), int(st["hi"])
        while True:
            if size <= band_max:
                got = (rank_table(band, cols, rank_col="_r",
                                  num_partitions=partitions_for(df.sparkSession, size))
                       .where(F.col("_r") == p - below).first())
                out[p] = tuple(got[c] for c in cols)
                break
            if lo == hi:                      # one value left: refine the next column
                fixed.append(lo)
                band = band.where(F.col(cols[i]) == F.lit(lo))
                i += 1
                if i == len(cols):            # all key columns equal: any row is the answer
                    out[p] = tuple(fixed)
                    break
                r = band.agg(F.min(cols[i]).alias("lo"), F.max(cols[i]).alias("hi")).first()
                lo, hi = int(r["lo"]), int(r["hi"])
                continue
            step = max(1, -(-(hi - lo + 1) // buckets))
            col = F.col(cols[i])
            cur = band.where(col.between(lo, hi))
            hist = sorted((int(h["b"]), int(h["c"])) for h in cur.groupBy(
                F.floor((col - F.lit(lo)) / F.lit(step)).cast("long").alias("b")).agg(
                F.count(F.lit(1)).alias("c")).collect())
            cum = 0
            for b, c in hist:
                if below + cum + c > p:
                    break
                cum += c
            below += cum
            lo, hi = lo + b * step, min(hi, lo + (b + 1) * step - 1)
            band = cur.where(col.between(lo, hi))
            size = c
    return out


# A band of at most this many values is ranked and read exactly.
SELECT_VALUES_FINAL = 50_000


class SelectionFallback(Exception):
    """Raised when histogram selection cannot proceed (non-finite values or
    too many passes); callers use the distributed rank instead."""


def group_value_stats(df: DataFrame, group: str, value: str) -> dict:
    """{group: (n, min, max)} of the non-null, non-NaN values (one aggregate)."""
    x = F.col(value).cast("double")
    return {r["_g"]: (int(r["n"]), r["lo"], r["hi"]) for r in
            df.where(x.isNotNull() & ~F.isnan(x)).groupBy(F.col(group).alias("_g")).agg(
                F.count(F.lit(1)).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).collect()}


def _bands(searches: dict) -> tuple[list, dict]:
    """The distinct (group, lo, hi) of the searches, and each search's place among
    them. A group's searches begin in one band and part by buckets: its bands are
    the same or have no value in common."""
    bands = list(dict.fromkeys((k[0], v[0], v[1]) for k, v in searches.items()))
    place = {b: i for i, b in enumerate(bands)}
    return bands, {k: place[(k[0], v[0], v[1])] for k, v in searches.items()}


def _band_of(bands: list) -> Column:
    """The one band a row lies in, or null."""
    return F.coalesce(*[F.when((F.col("_g") == F.lit(g)) & F.col("_x").between(lo, hi), F.lit(i))
                        for i, (g, lo, hi) in enumerate(bands)])


def select_values(df: DataFrame, group: str, value: str, positions: dict,
                  buckets: int = SELECT_BUCKETS, final: int = SELECT_VALUES_FINAL,
                  max_passes: int = 64, stats: dict | None = None) -> dict:
    """Values at 0-based positions of the ascending order of ``value`` within
    each group (nulls and NaN excluded), for all groups at once and without
    sorting the table. ``positions``: group -> list of positions.

    Each pass is ONE aggregation over the rows still in some group's band,
    into at most ``buckets`` equal-width buckets per group (count, min, max --
    collected: groups x buckets rows). Bucketing is monotone in the value, so
    the bucket holding a target is exactly the value range [its min, its max].
    A band with a single value answers at once (ties); a band of at most
    ``final`` values is ranked and the one position read. Returns
    {(group, position): value}."""
    spark = df.sparkSession
    base = df.select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_x")).where(
        F.col("_x").isNotNull() & ~F.isnan("_x"))
    if stats is None:
        stats = group_value_stats(df, group, value)
    out: dict = {}
    # one search per (group, position): [lo, hi] value band, rows below it, band size
    todo = {}
    for g, ps in positions.items():
        n, lo, hi = stats.get(g, (0, None, None))
        for p in ps:
            if p < 0 or p >= n:
                out[(g, p)] = None
            else:
                todo[(g, p)] = [lo, hi, 0, n]
    import math
    if any(not (math.isfinite(v[0]) and math.isfinite(v[1])) for v in todo.values()):
        raise SelectionFallback("non-finite values")
    passes = 0
    while todo:
        passes += 1
        if passes > max_passes:
            raise SelectionFallback("too many passes")
        for k, (lo, hi, below, size) in list(todo.items()):
            if lo == hi:
                out[k] = lo
                del todo[k]
        small = {k: v for k, v in todo.items() if v[3] <= final}
        if small:
            # all small bands at once: their rows, ranked by (band, value) in one
            # job; each search reads one rank
            bands, of = _bands(small)
            rows = base.select("_x", _band_of(bands).alias("_s")).where(F.col("_s").isNotNull())
            total = sum({of[k]: v[3] for k, v in small.items()}.values())
            r = rank_table(rows, ["_s", "_x"], rank_col="_r",
                           num_partitions=partitions_for(spark, total))
            start = r.groupBy("_s").agg(F.min("_r").alias("_o"))
            ks = list(small)
            want = spark.createDataFrame([(of[k], i, int(k[1] - small[k][2])) for i, k in enumerate(ks)],
                                         "_s int, _i int, _w long")
            hits = (r.join(F.broadcast(start), "_s").join(F.broadcast(want), "_s")
                    .where(F.col("_r") - F.col("_o") == F.col("_w")).select("_i", "_x").collect())
            for h in hits:                                     # one row per search
                out[ks[int(h["_i"])]] = h["_x"]
            for k in ks:
                del todo[k]
        if not todo:
            break
        # one histogram pass for every open band
        keys = list(todo)
        bands, of = _bands(todo)
        low, width = (F.element_at(F.array(*[F.lit(float(v)) for v in vs]), F.col("s") + 1)
                      for vs in ([lo for _, lo, _ in bands], [(hi - lo) / buckets for _, lo, hi in bands]))
        b = F.least(F.floor((F.col("_x") - low) / width), F.lit(buckets - 1)).cast("long")
        hist = (base.select("_x", _band_of(bands).alias("s")).where(F.col("s").isNotNull())
                .select("s", "_x", b.alias("b"))
                .groupBy("s", "b").agg(F.count(F.lit(1)).alias("c"), F.min("_x").alias("mn"),
                                       F.max("_x").alias("mx")).collect())
        per: dict = {}
        for r in hist:
            per.setdefault(int(r["s"]), []).append((int(r["b"]), int(r["c"]), r["mn"], r["mx"]))
        for k in keys:
            lo, hi, below, size = todo[k]
            p = k[1]
            cum = 0
            for b, c, mn, mx in sorted(per.get(of[k], [])):
                if below + cum + c > p:
                    todo[k] = [mn, mx, below + cum, c]
                    break
                cum += c
    return out


def select_quantiles(df: DataFrame, group: str, value: str, qs: dict[str, float],
                     stats: dict | None = None) -> dict:
    """{group: {name: value}} with linear interpolation at ``q * (n - 1)``
    (numpy default), from :func:`select_values`; ``n`` excludes nulls/NaN."""
    base = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    if stats is None:
        stats = group_value_stats(df, group, value)
    ns = {g: v[0] for g, v in stats.items()}
    need = {}
    for g, n in ns.items():
        ps = set()
        for q in qs.values():
            x = q * (n - 1)
            ps.update({int(x // 1), int(-(-x // 1))})
        need[g] = sorted(ps)
    got = select_values(base, group, value, need, stats=stats)
    out = {}
    for g, n in ns.items():
        out[g] = {}
        for name, q in qs.items():
            x = q * (n - 1)
            lo, hi = int(x // 1), int(-(-x // 1))
            a, b = got[(g, lo)], got[(g, hi)]
            out[g][name] = a + (x - lo) * (b - a)
    return out
