"""Streaming causal features (K1).

Rows arrive out of order within a watermark. Per card, state holds the
running history (first time, count, mean, M2 of amounts, and the times of the
last 24 hours) plus a buffer of rows not yet below the watermark. A buffered
row is emitted once the watermark passes its second: no on-time row that
precedes it in ``(ts_sec, txn_id)`` order can still arrive (it would be late
and dropped by Spark), so the emitted table equals the batch one. State stays
bounded: history is summarised, times older than 24 h are pruned, the buffer
spans at most the watermark delay.

Cards are dealt by hash into ``BUCKETS`` groups, whose state holds each card's
own: a call of the function costs some milliseconds whatever it is given, so
many cards of few rows share one.

Event time is the whole second (``timestamp_seconds(ts_sec)``) so rows of the
same second are released together and ordered by id.
"""

from __future__ import annotations

import bisect
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from txnlens.operators.causal import DAY_SECONDS, HOUR_SECONDS, Z_EPS

#: Groups that cards are dealt into; fixed for the life of a stream's checkpoint.
BUCKETS = 4096
#: Types of the row id and the card follow the input.
OUTPUT_SCHEMA = ("txn_id {id}, card_id {card}, ts_sec long, velocity_1h long, velocity_24h long, "
                 "amt_zscore double, card_tenure_days double")
# A group's cards, one entry each; all their distinct seconds of the last 24 h with
# cumulative counts, ``held`` of them a card (at most 86,401, however many
# transactions the card makes); and the buffered rows.
STATE_SCHEMA = ("cards array<{card}>, first array<long>, n array<long>, mean array<double>, m2 array<double>, "
                "held array<long>, secs array<long>, cum array<long>, "
                "buf_card array<{card}>, buf_ts array<long>, buf_id array<{id}>, buf_amt array<double>")
OUTPUT = ["txn_id", "card_id", "ts_sec", "velocity_1h", "velocity_24h", "amt_zscore", "card_tenure_days"]


def _plain(column) -> list:
    """Values of a pandas column, None for a missing one."""
    values = column.tolist()
    return [None if m else v for v, m in zip(values, column.isna())] if column.hasnans else values


def _whole(column) -> list:
    """Row ids: whole numbers come as floats beside a missing one."""
    return [int(v) if isinstance(v, float) else v for v in _plain(column)]


def _released(card, rows, history, out) -> tuple:
    """Append the features of one card's final rows, in order; its history after them."""
    first, n, mean, m2, secs, cum = history
    total = cum[-1] if cum else 0
    for t, i, a in rows:
        lo1 = bisect.bisect_left(secs, t - HOUR_SECONDS)
        lo24 = bisect.bisect_left(secs, t - DAY_SECONDS)
        v1 = total - (cum[lo1 - 1] if lo1 > 0 else 0)
        v24 = total - (cum[lo24 - 1] if lo24 > 0 else 0)
        z = 0.0 if n < 2 else None if a is None else (a - mean) / ((m2 / n) ** 0.5 + Z_EPS)
        ten = (t - first) / float(DAY_SECONDS) if first is not None else 0.0
        out.append((i, card, t, v1, v24, z, ten))
        first = t if first is None else first
        if a is not None:
            n += 1
            d = a - mean
            mean += d / n
            m2 += d * (a - mean)
        total += 1
        if secs and secs[-1] == t:
            cum[-1] = total
        else:
            secs.append(t)
            cum.append(total)
    # drop seconds no later row's 24 h window can reach
    k = bisect.bisect_left(secs, secs[-1] - DAY_SECONDS)
    if k > 0:
        base = cum[k - 1]
        secs, cum = secs[k:], [c - base for c in cum[k:]]
    return first, n, mean, m2, secs, cum


def _step(key, pdf_iter, state):
    import pandas as pd

    if state.exists:
        cards, first, n, mean, m2, held, secs, cum, *buffered = state.get
        ends = list(accumulate(held))
        known = {c: (f, k, m, q, list(secs[e - h: e]), list(cum[e - h: e]))
                 for c, f, k, m, q, h, e in zip(cards, first, n, mean, m2, held, ends)}
        buf = list(zip(*buffered))
    else:
        known, buf = {}, []
    wm = state.getCurrentWatermarkMs()
    for pdf in pdf_iter:
        # A new row at or below the watermark is late: dropped, as Spark does.
        # A missing amount or id is None, not NaN.
        buf.extend(r for r in zip(_plain(pdf["card_id"]), pdf["ts_sec"].tolist(), _whole(pdf["txn_id"]), _plain(pdf["amt"]))
                   if not (wm and wm > 0 and r[1] * 1000 <= wm))
    out, keep, final = [], [], {}
    for r in buf:
        # Spark drops rows at or below the watermark, so those seconds are final.
        if wm and wm > 0 and r[1] * 1000 <= wm:
            final.setdefault(r[0], []).append(r[1:])
        else:
            keep.append(r)
    for card, rows in final.items():
        rows.sort(key=lambda r: (r[0], r[1] is not None, 0 if r[1] is None else r[1]))
        known[card] = _released(card, rows, known.get(card, (None, 0, 0.0, 0.0, [], [])), out)
    first, n, mean, m2, secs, cum = zip(*known.values()) if known else [()] * 6
    state.update((list(known), list(first), list(n), list(mean), list(m2), [len(x) for x in secs],
                  [t for x in secs for t in x], [c for x in cum for c in x],
                  *(list(x) for x in (zip(*keep) if keep else [()] * 4))))
    if keep:
        # wake up once the watermark passes the oldest buffered second
        state.setTimeoutTimestamp(max(min(r[1] for r in keep) * 1000 + 1000, (wm or 0) + 1))
    if out:
        yield pd.DataFrame(out, columns=OUTPUT)


def stream_causal_features(sdf: DataFrame, delay: str = "1 hour", card: str = "card_id",
                           ts: str = "ts_sec", amount: str = "amt", key: str = "txn_id",
                           buckets: int = BUCKETS) -> DataFrame:
    """Streaming DataFrame of causal features (append mode). ``buckets``: groups that
    cards are dealt into."""
    base = sdf.select(F.col(key).alias("txn_id"), F.col(card).alias("card_id"),
                      F.col(ts).cast("long").alias("ts_sec"),
                      F.col(amount).cast("double").alias("amt"),
                      F.timestamp_seconds(F.col(ts)).alias("event_time"))
    placed = F.col("card_id").isNotNull() & F.col("ts_sec").isNotNull()
    kinds = {"id": base.schema["txn_id"].dataType.simpleString(), "card": base.schema["card_id"].dataType.simpleString()}
    known = (base.where(placed).withWatermark("event_time", delay)
             .withColumn("bucket", F.pmod(F.xxhash64("card_id"), F.lit(buckets)))
             .groupBy("bucket")
             .applyInPandasWithState(_step, OUTPUT_SCHEMA.format(**kinds), STATE_SCHEMA.format(**kinds), "append",
                                     GroupStateTimeout.EventTimeTimeout))
    # A null card or time has no history: zeros, without state.
    nulls = base.where(~placed).select(
        "txn_id", "card_id", "ts_sec", F.lit(0).cast("long").alias("velocity_1h"),
        F.lit(0).cast("long").alias("velocity_24h"), F.lit(0.0).alias("amt_zscore"),
        F.lit(0.0).alias("card_tenure_days"))
    return known.unionByName(nulls)
