"""Stateful operators in batch form: the state is a window over the key's rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.operators import panes

HOUR_MS = 3_600_000


def _numbered(df: DataFrame, key: str, order: list[str], out: str) -> DataFrame:
    """``out``: the number of a row among its key's, from 0.  A key's rows are counted by buckets of the first order column."""
    return panes.running(df, order[0], {out: panes.running_sum(F.lit(1))}, include_current=False, ties=order[1:], keys=[key])


def count_buffer(df: DataFrame, key: str, order: list[str], sizes: dict[str, int], default: int) -> DataFrame:
    """Rows flushed from a buffer per key that empties when full, with their ``batch`` number; what doesn't fill one stays unflushed."""
    size = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col(key)) if sizes else F.lit(None), F.lit(default))
    total = df.groupBy(F.col(key).alias("rf_key")).agg(F.count(F.lit(1)).alias("rf_n"))
    d = _numbered(df, key, order, "rf_i").withColumn("rf_size", size).join(total, F.col(key).eqNullSafe(F.col("rf_key")))
    return d.withColumn("batch", F.expr("rf_i div rf_size")).where("(batch + 1) * rf_size <= rf_n").select(*df.columns, "batch")


def size_batches(df: DataFrame, key: str, order: list[str], size: int) -> DataFrame:
    """``batch`` numbers of a batcher per key; the last batch, flushed at the end of time, may be smaller."""
    return _numbered(df, key, order, "rf_i").withColumn("batch", F.expr(f"rf_i div {size}")).drop("rf_i")


def flush_chain(df: DataFrame, key: str, at: Column, wait: int, value: Column | None = None) -> DataFrame:
    """What is flushed ``wait`` after the first row since the last flush, per key: ``key, first, due, n, total``.

    ``at`` is an integer time; a row at the due time itself still belongs to the flush.
    Rows without a time are left out; null keys are a key.  A key's flushes follow from
    each other, so its rows pass one task in time order, but none are held there: memory
    doesn't grow with a key.
    """
    rows = df.select(F.col(key), at.cast("long").alias("rf_at"), (F.lit(0) if value is None else value).cast("long").alias("rf_value")).where("rf_at is not null")
    dealt = rows.repartition(key).sortWithinPartitions(key, "rf_at")
    schema = T.StructType([df.schema[key], *[T.StructField(c, T.LongType()) for c in ("first", "due", "n", "total")]])
    return dealt.mapInArrow(_chained(key, wait), schema)


def _chained(key: str, wait: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, open_ = None, None  # of the open flush: key, first, due, n, total
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, at, value = batch.column(0), np.asarray(batch.column(1)), np.asarray(batch.column(2).fill_null(0))
            kind, done = keys.type, []
            codes = np.asarray(keys.dictionary_encode(null_encoding="encode").indices)
            ends = [*(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(at)]
            i, sums = 0, np.append(0, np.cumsum(value))
            for end in ends:
                name = keys[i].as_py()
                if open_ and open_[0] != name:
                    done.append(open_)
                    open_ = None
                while i < end:
                    if open_ is None:
                        open_ = (name, int(at[i]), int(at[i]) + wait, 0, 0)
                    to = i + int(np.searchsorted(at[i:end], open_[2], side="right"))
                    open_ = (*open_[:3], open_[3] + to - i, open_[4] + int(sums[to] - sums[i]))
                    if to < end:
                        done.append(open_)
                        open_ = None
                    i = to
            if done:
                yield _flushes(done, key, kind)
        if open_:
            yield _flushes([open_], key, kind)

    return run


def _flushes(rows: list[tuple], key: str, kind: pa.DataType) -> pa.RecordBatch:
    first, *rest = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(first, kind), *[pa.array(c, pa.int64()) for c in rest]], [key, "first", "due", "n", "total"])


def time_buffer(df: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Flush times of a buffer whose timer starts with the first row after a flush: ``key, flush_at, n``."""
    flushed = flush_chain(df, key, F.unix_micros(F.col(ts).cast("timestamp")), seconds * 1_000_000)
    return flushed.select(key, F.timestamp_micros("due").alias("flush_at"), "n")


def looping_ticks(df: DataFrame, key: str, ts: str, first_ms: int, every_ms: int) -> DataFrame:
    """Ticks of a timer per key: ``first_ms`` after the key's first row, then every ``every_ms`` to its last."""
    ms = F.unix_millis(F.col(ts).cast("timestamp"))
    span = df.groupBy(key).agg(F.min(ms).alias("lo"), F.max(ms).alias("hi")).where(F.col("lo") + first_ms <= F.col("hi"))
    ticks = span.select(key, F.explode(F.sequence(F.col("lo") + first_ms, F.col("hi"), F.lit(every_ms).cast("long"))).alias("ms"))
    return ticks.select(key, F.timestamp_millis("ms").alias("tick"), F.lit(".").alias("value"))


def running_value(df: DataFrame, key: str, price: str, order: list[str], seed: DataFrame | None = None) -> DataFrame:
    """Each row with its key's running ``total`` and ``cnt``, on top of a seed table ``key, total, cnt`` (one row a key)."""
    out = panes.running(df, order[0], {"total": panes.running_sum(price), "cnt": panes.running_sum(F.lit(1))}, ties=order[1:], keys=[key])
    if seed is None:
        return out
    s = seed.select(key, F.col("total").alias("rf_total"), F.col("cnt").alias("rf_cnt"))
    joined = out.join(s, key, "left")
    return joined.withColumn("total", F.col("total") + F.coalesce("rf_total", F.lit(0))).withColumn("cnt", F.col("cnt") + F.coalesce("rf_cnt", F.lit(0))).drop("rf_total", "rf_cnt")


def track_steps(df: DataFrame, key: str = "track") -> DataFrame:
    """Consecutive positions of each track: ``key, ts0, ts1`` (ms) and the ``length`` between them.

    The position before one is the greatest of those before it, so it is found like any
    running value, by buckets of time.
    """
    from rillflow.functions import geo

    at = F.struct("ts", "lat", "lon")
    d = panes.running(df.select(key, "ts", "lat", "lon"), "ts", {"rf_before": panes.running_max(at)}, bucket=HOUR_MS, include_current=False, ties=["lat", "lon"], keys=[key])
    moved = d.where("rf_before is not null")
    return moved.select(key, F.col("rf_before.ts").alias("ts0"), F.col("ts").alias("ts1"), geo.distance(F.col("rf_before.lat"), F.col("rf_before.lon"), F.col("lat"), F.col("lon")).alias("length"))


def minute_metrics(df: DataFrame, key: str = "track", period_ms: int = 60_000) -> DataFrame:
    """Steps cut at period boundaries: ``key, ts`` (the segment's end), ``length``, ``duration``.  Uniform speed within a step."""
    steps = track_steps(df, key).where("ts1 > ts0")
    first = F.expr(f"ts0 div {period_ms}")
    last = F.expr(f"(ts1 - 1) div {period_ms}")
    parts = steps.withColumn("m", F.explode(F.sequence(first, last)))
    a, b = F.greatest("ts0", F.col("m") * period_ms), F.least("ts1", (F.col("m") + 1) * period_ms)
    cut = parts.withColumn("rf_a", a).withColumn("rf_b", b)
    return cut.select(key, ((F.col("rf_a") + F.col("rf_b")) / 2).cast("long").alias("mid"), F.col("rf_b").alias("ts"), (F.col("length") * (F.col("rf_b") - F.col("rf_a")) / (F.col("ts1") - F.col("ts0"))).alias("length"), (F.col("rf_b") - F.col("rf_a")).alias("duration"))


def pace_notifications(short: DataFrame, long: DataFrame, key: str) -> DataFrame:
    """``key, ts, faster``: short pace over long pace above 1.1 (a ratio below 0 can't occur); a long pace of 0 or none notifies nothing.

    Both have ``key, window_end`` (ms) and ``pace``; the long window with the short window's end is taken.
    """
    named = long.select(key, "window_end", F.col("pace").alias("long_pace"))
    ratio = F.try_divide(F.col("pace"), F.col("long_pace"))
    return short.join(named, [key, "window_end"]).where((F.col("long_pace") != 0) & ((ratio < 0) | (ratio > 1.1))).select(key, F.col("window_end").alias("ts"), (ratio > 1).alias("faster"))
