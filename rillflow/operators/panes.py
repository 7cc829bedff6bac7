"""Panes and lateness in replay: arrival order is a column, so every firing is a row.

A watermark is the running maximum of event times over arrivals.  Running values over
all rows are computed in two levels (buckets of arrivals, then within a bucket), so no
task holds the whole stream.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bucket_of(df: DataFrame, col: str, width: int | None = None) -> Column:
    """A coarse number that rises with a column: hours of a time, ``width`` (2^21) of a whole number; one bucket for other types."""
    kind = df.schema[col].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.floor(F.unix_micros(F.col(col).cast("timestamp")) / (width or 3_600_000_000))
    return F.floor(F.col(col) / (width or 1 << 21)) if isinstance(kind, T.IntegralType) else F.lit(0)


def running(df: DataFrame, arrival: str, out: dict[str, tuple], bucket: int | None = None, include_current: bool = True, ties: list[str | Column] = (), keys: list[str] = ()) -> DataFrame:
    """Running aggregates over all rows, or those of each of ``keys``, in order of the column ``arrival``, then of ``ties``.

    ``out`` maps a column to (partial, merge, join): aggregates over rows and over their
    partial results, and a function of two partial results.  Rows are summed up per
    bucket of arrivals (:func:`bucket_of`), the sums are carried over the buckets, and
    only a bucket is ordered in one task, so a key may hold any share of all rows.
    """
    b = "rf_bucket"
    d = df.withColumn(b, bucket_of(df, arrival, bucket))
    totals = d.groupBy(*keys, b).agg(*[p.alias(f"rf_t_{k}") for k, (p, _, _) in out.items()])
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    carried = totals.select(*[F.col(k).alias(f"rf_k_{k}") for k in keys], F.col(b).alias("rf_b"), *[m(F.col(f"rf_t_{k}")).over(before).alias(f"rf_c_{k}") for k, (_, m, _) in out.items()])
    within = Window.partitionBy(*keys, b).orderBy(arrival, *ties).rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"rf_k_{k}")) for k in keys], F.col(b).eqNullSafe(F.col("rf_b")))
    seen = d.select(*df.columns, b, *[p.over(within).alias(f"rf_w_{k}") for k, (p, _, _) in out.items()]).join(carried, same)
    return seen.select(*[c for c in df.columns if c not in out], *[join(F.col(f"rf_c_{k}"), F.col(f"rf_w_{k}")).alias(k) for k, (_, _, join) in out.items()])


def _add(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))


def running_sum(col: str | Column) -> tuple:
    return F.sum(col), F.sum, _add


def running_max(col: str | Column) -> tuple:
    return F.max(col), F.max, lambda a, b: F.greatest(a, b)


def with_watermark(df: DataFrame, arrival: str, ts: str = "ts", ties: list[str] = (), delay: str | None = None) -> DataFrame:
    """``watermark``: the latest event time that arrived before the row, less ``delay``; null for the first."""
    out = running(df, arrival, {"watermark": running_max(ts)}, include_current=False, ties=ties)
    return out.withColumn("watermark", F.col("watermark") - F.expr(f"interval {delay}")) if delay else out


def late_split(df: DataFrame, lateness: str) -> DataFrame:
    """Column ``tag``: ``droppable`` where the row's window closed (window end + lateness at or before the watermark), else ``main``."""
    late = F.coalesce(F.col("window_end") + F.expr(f"interval {lateness}") <= F.col("watermark"), F.lit(False))
    return df.withColumn("tag", F.when(late, "droppable").otherwise("main"))


def timed_panes(df: DataFrame, keys: list[str], value: str, lateness: str, every: Column) -> DataFrame:
    """Accumulating panes of windowed sums: early ones per period, one on time, late ones per period.

    ``df`` has ``window_end``, ``watermark``; ``every`` numbers the processing-time periods.
    Returns ``keys, pane_timing, period, total``; droppable rows are left out.
    """
    split = late_split(df, lateness).where("tag = 'main'")
    timed = split.withColumn("pane_timing", F.when(_closed(), "LATE").otherwise("EARLY")).withColumn("period", every)
    deltas = timed.groupBy(*keys, "pane_timing", "period").agg(F.sum(value).alias("delta"))
    total = F.sum("delta").over(Window.partitionBy(*keys).orderBy("pane_timing", "period"))
    panes = deltas.select(*keys, "pane_timing", "period", total.alias("total"))
    on_time = deltas.where("pane_timing = 'EARLY'").groupBy(*keys).agg(F.lit("ON_TIME").alias("pane_timing"), F.max("period").alias("period"), F.sum("delta").alias("total"))
    return panes.unionByName(on_time)


def period_panes(df: DataFrame, keys: list[str], value: str, every: Column, accumulating: bool = True) -> DataFrame:
    """A pane per processing-time period: a running total, or only the period's own sum (discarding)."""
    deltas = df.withColumn("period", every).groupBy(*keys, "period").agg(F.sum(value).alias("total"))
    return deltas.withColumn("total", F.sum("total").over(Window.partitionBy(*keys).orderBy("period"))) if accumulating else deltas


def _closed() -> Column:
    return F.coalesce(F.col("window_end") <= F.col("watermark"), F.lit(False))


def default_panes(df: DataFrame, keys: list[str], value: Column, lateness: str, order: list[str], accumulating: bool = True) -> DataFrame:
    """Panes of the default trigger: one when the watermark passes the window's end, then one for every late element.

    ``df`` has ``window_end`` and ``watermark``.  Returns ``keys, pane_timing, pane, total``:
    pane 0 is on time, late ones count from 1 in arrival ``order``.  Rows of expired windows
    are left out; a window without an element in time has no pane 0 (nothing is fired for
    nothing).
    """
    kept = late_split(df, lateness).where("tag = 'main'").withColumn("rf_v", value)
    on_time = kept.where(~_closed()).groupBy(*keys).agg(F.sum("rf_v").alias("rf_base"))
    late = kept.where(_closed())
    per_key = Window.partitionBy(*keys).orderBy(*order)
    gone = late.select(*keys, F.row_number().over(per_key).cast("long").alias("pane"), "rf_v", F.sum("rf_v").over(per_key.rowsBetween(Window.unboundedPreceding, 0)).alias("rf_sum"))
    if accumulating:
        gone = gone.join(on_time, keys, "left").withColumn("total", F.col("rf_sum") + F.coalesce("rf_base", F.lit(0)))
    else:
        gone = gone.withColumn("total", F.col("rf_v"))
    first = on_time.select(*keys, F.lit("ON_TIME").alias("pane_timing"), F.lit(0).cast("long").alias("pane"), F.col("rf_base").alias("total"))
    return first.unionByName(gone.select(*keys, F.lit("LATE").alias("pane_timing"), "pane", "total"))


def never_panes(df: DataFrame, keys: list[str], value: Column, lateness: str) -> DataFrame:
    """One pane per window when it expires: all of its rows that were not too late, ``keys, total``."""
    return late_split(df, lateness).where("tag = 'main'").groupBy(*keys).agg(F.sum(value).alias("total"))


def delayed_panes(df: DataFrame, key: str, at: Column, delay: int, value: Column, accumulating: bool = True) -> DataFrame:
    """Panes that fire ``delay`` after the first element of each: ``key, fired, n, total``.

    ``at`` is the processing time as an integer.  What comes after a firing begins the next pane.
    """
    from rillflow.operators.stateful import flush_chain

    panes = flush_chain(df, key, at, delay, value)
    if accumulating:
        panes = panes.withColumn("total", F.sum("total").over(Window.partitionBy(key).orderBy("due")))
    return panes.select(key, F.col("due").alias("fired"), "n", "total")


def expired_windows(df: DataFrame, keys: list[str], lateness: str, arrival: str) -> DataFrame:
    """The first arrival at which each window has expired (its end and ``lateness`` are behind the watermark): ``keys, window_end, expired_at``.

    The place for what must happen once a window can change no more.  Windows that no
    arrival finds expired have a null.
    """
    ends = df.groupBy(*keys, "window_end").agg(F.lit(1).alias("rf_one")).drop("rf_one")
    marks = df.where("watermark is not null").groupBy("watermark").agg(F.min(arrival).alias("rf_at"))
    # in time order, windows (0) and watermarks (1) in one row each: the first mark at or after the expiry
    limit = (F.col("window_end") + F.expr(f"interval {lateness}")).alias("rf_when")
    found = limits_after(ends.select("window_end", limit).distinct(), marks)
    return ends.join(found, "window_end", "left").withColumnRenamed("rf_found", "expired_at")


def limits_after(limits: DataFrame, marks: DataFrame) -> DataFrame:
    """For each ``window_end, rf_when`` the ``rf_at`` of the least watermark at or after it, which is the first there, watermarks being monotone."""
    both = limits.withColumn("rf_at", F.lit(None).cast("long")).unionByName(marks.select(F.lit(None).cast(limits.schema["window_end"].dataType).alias("window_end"), F.col("watermark").alias("rf_when"), "rf_at"))
    # days bound what one task orders; the first mark of later days is carried back
    day = F.date_trunc("day", "rf_when")
    d = both.withColumn("rf_day", day)
    firsts = d.groupBy("rf_day").agg(F.min("rf_at").alias("rf_first"))
    later = Window.orderBy(F.desc("rf_day")).rowsBetween(Window.unboundedPreceding, -1)  # one row a day
    carried = firsts.select("rf_day", F.min("rf_first").over(later).alias("rf_later"))
    after = Window.partitionBy("rf_day").orderBy(F.desc("rf_when"), F.col("rf_at").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = d.withColumn("rf_here", F.min("rf_at").over(after)).join(carried, "rf_day")
    return seen.where("window_end is not null").select("window_end", F.coalesce("rf_here", "rf_later").alias("rf_found"))


@dataclass(frozen=True)
class Windowing:
    """How elements are windowed and when results are fired; one strategy can be taken over from another with changes."""

    size: str
    every: str | None = None
    lateness: str = "0 seconds"
    trigger: str = "default"
    accumulating: bool = True
    delay: str | None = None

    def but(self, **changes) -> Windowing:
        return replace(self, **changes)

    def assign(self, df: DataFrame, arrival: str, ties: list[str] = ()) -> DataFrame:
        from rillflow.operators import windows

        marked = with_watermark(df, arrival, ties=ties, delay=self.delay)
        return windows.sliding(marked, self.size, self.every) if self.every else windows.fixed(marked, self.size)

    def panes(self, df: DataFrame, keys: list[str], value: Column, arrival: str, ties: list[str] = ()) -> DataFrame:
        """Fired sums per key and window; ``trigger`` is ``default`` or ``never``."""
        at = self.assign(df, arrival, ties)
        if self.trigger == "never":
            return never_panes(at, [*keys, "window_end"], value, self.lateness)
        if self.trigger == "default":
            return default_panes(at, [*keys, "window_end"], value, self.lateness, [arrival, *ties], self.accumulating)
        raise ValueError(f"no trigger {self.trigger}")
