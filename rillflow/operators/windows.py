"""Event-time windows as columns ``window_start`` and ``window_end``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _flat(df: DataFrame, ts: str, *spec: str) -> DataFrame:
    cols = [c for c in df.columns if c not in ("window_start", "window_end")]
    return df.withColumn("rf_w", F.window(ts, *spec)).select(*cols, F.col("rf_w.start").alias("window_start"), F.col("rf_w.end").alias("window_end"))


def fixed(df: DataFrame, size: str, ts: str = "ts") -> DataFrame:
    return _flat(df, ts, size)


def sliding(df: DataFrame, size: str, every: str, ts: str = "ts") -> DataFrame:
    """One row per window that holds the element."""
    return _flat(df, ts, size, every)


def sized_by(df: DataFrame, seconds: Column, ts: str = "ts") -> DataFrame:
    """Windows whose size is data: ``start = ts - (ts + size) % size``.  Rows with a size that isn't positive are dropped."""
    at = F.unix_millis(F.col(ts).cast("timestamp"))
    d = df.withColumn("rf_size", (seconds * 1000).cast("long")).where("rf_size > 0").withColumn("rf_at", at)
    start = F.col("rf_at") - F.pmod(F.col("rf_at") + F.col("rf_size"), F.col("rf_size"))
    return d.withColumn("window_start", F.timestamp_millis(start)).withColumn("window_end", F.timestamp_millis(start + F.col("rf_size"))).drop("rf_size", "rf_at")


def rewindow(df: DataFrame, size: str) -> DataFrame:
    """Results of a window put into other windows by their time, the last millisecond of the old window."""
    return fixed(df.withColumn("rf_ts", F.expr("window_end - interval 1 millisecond")), size, "rf_ts").drop("rf_ts")


def window_labels(df: DataFrame, size: str, step: str, ts: str = "ts") -> DataFrame:
    """Every window of the range of ``ts``, one row per step."""
    bounds = df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    steps = bounds.select(F.explode(F.sequence("lo", "hi", F.expr(f"interval {step}"))).alias(ts))
    return fixed(steps, size, ts).select("window_start", "window_end").distinct()


def combined_time(how: str, ts: str = "ts") -> Column:
    """The time of a window's result as an aggregate: ``LATEST`` or ``EARLIEST`` of its elements, or ``END_OF_WINDOW``, its last millisecond."""
    if how == "END_OF_WINDOW":
        return F.max(F.expr("window_end - interval 1 millisecond"))
    return {"LATEST": F.max, "EARLIEST": F.min}[how](ts)


def with_timestamp(df: DataFrame, at: Column, ts: str = "ts", skew: str | None = None) -> DataFrame:
    """Elements put out with the time ``at``; one more than ``skew`` before its old time is an error (no ``skew``: any time is fine)."""
    if skew is None:
        return df.withColumn(ts, at)
    ok = F.assert_true(at >= F.col(ts) - F.expr(f"interval {skew}"), f"a time is more than {skew} before the element's own")
    return df.withColumn(ts, F.when(ok.isNull(), at))
