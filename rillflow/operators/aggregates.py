"""Aggregations.  All of them combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_per_element(df: DataFrame, *cols: str, out: str = "n") -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(out))


def sum_or_zero(col: Column) -> Column:
    return F.coalesce(F.sum(col), F.lit(0))


def mean_or_nan(col: Column) -> Column:
    return F.coalesce(F.avg(col), F.lit(float("nan")))


def top_k(df: DataFrame, k: int, by: list[Column], per: list[str] = ()) -> DataFrame:
    """The first ``k`` rows in the order ``by``, of all or per group.  Without groups this is a heap per task, not a sort of all rows."""
    if not per:
        return df.orderBy(*by).limit(k)
    ranked = df.withColumn("rf_rank", F.row_number().over(Window.partitionBy(*per).orderBy(*by)))
    return ranked.where(F.col("rf_rank") <= k).drop("rf_rank")


def latest(df: DataFrame, value: str, order: list[str], per: list[str] = (), out: str | None = None) -> DataFrame:
    """The value of the row that is last in ``order``; no key gives one row, null if there are no rows."""
    return df.groupBy(*per).agg(F.max_by(value, F.struct(*order)).alias(out or value))


def below_mean(df: DataFrame, col: str, condition: Column) -> DataFrame:
    """Rows that meet the condition and are below the mean over all rows.  The mean is one row, broadcast."""
    mean = df.agg(F.avg(col).alias("rf_mean"))
    return df.where(condition).join(F.broadcast(mean), F.col(col) < F.col("rf_mean")).drop("rf_mean")


def score_board(df: DataFrame, key: str, value: str, per: list[str]) -> DataFrame:
    """Per group a map from key to total: totals first, so a map has one entry a key."""
    totals = df.groupBy(*per, key).agg(F.sum(value).alias("rf_total"))
    return totals.groupBy(*per).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "rf_total")))).alias("board"))


def average_pace(length: str, duration_ms: str) -> Column:
    """Metres a second over a group; null where the durations sum to 0."""
    return F.try_divide(F.sum(length) * 1000, F.sum(duration_ms))


def pi_estimate(spark, samples: int, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """4 * share of random points in the unit square that fall in the unit circle."""
    points = spark.range(0, samples, 1, partitions) if partitions else spark.range(samples)
    outside = points.select((F.pow(F.rand(seed), 2) + F.pow(F.rand(seed + 1), 2) > 1).cast("long").alias("o"))
    return outside.agg((4 * (1 - F.sum("o") / F.lit(samples))).alias("pi"))
