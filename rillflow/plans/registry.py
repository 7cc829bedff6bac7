"""Where queries are registered, and the tables that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Arrival in replay: an odd factor modulo 2^31 permutes the event ids below that; further ones tie, and the id decides.
ARRIVAL = "event_id * 1327217885 % 2147483648"
#: Arrivals in one processing-time period of the queries: a twentieth, and a fifth, of all.
SHORT, LONG = 107_374_183, 429_496_730
TIES = ["event_id"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with value in integer cents and a replay arrival number."""
    return table(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long")).withColumn("arrival", F.expr(ARRIVAL))


EVENTS = f"e AS (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents, {ARRIVAL} AS arrival FROM events)"


def flat(df: DataFrame) -> DataFrame:
    """Instants as the wall-clock time stamps that the tables use."""
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])
