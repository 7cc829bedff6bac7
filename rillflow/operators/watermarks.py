"""Watermark policies in replay: what a source would have promised after each arrival or at each check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.operators.panes import running, running_max

#: The least and the greatest event time: what a row stands for whose time can't be read.
LEAST, GREATEST = "1970-01-01", "9999-12-31"


def bounded_delay(df: DataFrame, arrival: str, delay: str, ts: str = "ts", unreadable: str = LEAST, ties: list[str] = ()) -> DataFrame:
    """``watermark`` after each row: the latest event time so far less ``delay``.

    A null time counts as ``unreadable``: ``LEAST`` holds nothing back and moves nothing,
    ``GREATEST`` closes every window for good (the poisoned watermark of a policy that
    takes unreadable rows for the end of time).
    """
    at = F.coalesce(F.col(ts), F.lit(unreadable).cast(df.schema[ts].dataType))
    seen = running(df, arrival, {"watermark": running_max(at)}, ties=ties)
    return seen.withColumn("watermark", F.col("watermark") - F.expr(f"interval {delay}"))


def idle_advance(df: DataFrame, part: str, processed: Column, checks: DataFrame, every: str, delay: str, ts: str = "ts") -> DataFrame:
    """``part, check, watermark``: each partition's watermark at each check, which idle partitions don't hold back.

    ``checks`` has ``check``, times ``every`` apart.  A partition that has caught up and
    whose latest event time is more than ``delay`` before the check, or after it, has the
    check's time less ``delay``; otherwise it has its latest event time less ``delay``.
    """
    wait = F.expr(f"interval {delay}")
    latest = df.select(part, processed.alias("rf_p"), ts)
    bucket = F.window("rf_p", every)
    at_check = F.when(bucket["start"] == F.col("rf_p"), bucket["start"]).otherwise(bucket["end"])
    latest = latest.withColumn("check", at_check).groupBy(part, "check").agg(F.max(ts).alias("rf_max"))
    grid = df.select(part).distinct().join(F.broadcast(checks))  # one row a partition and check
    so_far = Window.partitionBy(part).orderBy("check").rowsBetween(Window.unboundedPreceding, 0)
    top = grid.join(latest, [part, "check"], "full").withColumn("rf_top", F.max("rf_max").over(so_far))
    idle = F.coalesce((F.col("rf_top") > F.col("check")) | (F.col("check") - wait > F.col("rf_top")), F.lit(True))
    out = top.join(F.broadcast(checks.withColumn("rf_asked", F.lit(True))), "check")
    return out.select(part, "check", (F.when(idle, F.col("check")).otherwise(F.col("rf_top")) - wait).alias("watermark"))


def slowest(marks: DataFrame) -> DataFrame:
    """``check, watermark`` of a source: the least of its partitions'."""
    return marks.groupBy("check").agg(F.min("watermark").alias("watermark"))


def manual(df: DataFrame, arrival: str, promised: str, ties: list[str] = ()) -> DataFrame:
    """``watermark`` as the source sets it after each poll (``promised``, null where it says nothing); it never goes back."""
    return running(df, arrival, {"watermark": running_max(promised)}, ties=ties)


def time_only(df: DataFrame, keep: list[str]) -> DataFrame:
    """All elements filtered out, their time kept: rows with ``keep`` alone, to be united with a stream whose watermark they advance."""
    return df.select(*[F.col(c) if c in keep else F.lit(None).cast(t).alias(c) for c, t in df.dtypes]).withColumn("heartbeat", F.lit(True))
