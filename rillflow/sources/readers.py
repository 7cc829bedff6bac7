"""Sources: text, chunks, directories, tables, generators, message buses, scripted streams."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """A row per line; a line belongs to the split that holds its first byte."""
    return spark.read.text(path)


def chunks(spark: SparkSession, path: str, size: int = 1 << 20, split: int = 32 << 20) -> DataFrame:
    """Files as pieces of ``size`` bytes: ``path, start, content``.  A file is read in ranges of ``split`` bytes, by many tasks."""
    return _ranges(spark).option("path", path).option("size", size).option("split", split).load()


def line_ranges(spark: SparkSession, path: str, split: int = 32 << 20, encoding: str = "utf-8") -> DataFrame:
    """Files as lines ``path, start, value``; a line belongs to the range that holds its first byte."""
    return _ranges(spark).option("path", path).option("mode", "lines").option("split", split).option("encoding", encoding).load()


def _ranges(spark: SparkSession):
    from rillflow.sources.ranges import FileRangeSource

    spark.dataSource.register(FileRangeSource)
    return spark.read.format("file_ranges")


def read_all(spark: SparkSession, patterns: DataFrame, col: str = "pattern", most: int = 10_000) -> DataFrame:
    """Lines of all files that match the globs in a column, read anew at every call: ``path, value``.

    The globs are the driver's (``most`` at most, or it is an error); a glob without files gives none.
    """
    globs = [r[0] for r in patterns.select(col).where(F.col(col).isNotNull()).distinct().limit(most + 1).collect()]
    if len(globs) > most:
        raise ValueError(f"more than {most} globs")
    found = [p for p in globs if _matches(spark, p)]
    if not found:
        return spark.createDataFrame([], "path string, value string")
    return spark.read.text(found).select(F.col("_metadata.file_path").alias("path"), "value")


def _matches(spark: SparkSession, pattern: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.text(pattern)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise
    return True


def watch_directory(spark: SparkSession, path: str, per_batch: int | None = None) -> DataFrame:
    """A stream of the lines of every file once, also in subdirectories, with ``path`` and the file's time."""
    reader = spark.readStream.format("text").option("recursiveFileLookup", "true")
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.load(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("ts"))


def message_bus(spark: SparkSession, fmt: str = "kafka", metadata: bool = False, **options: str) -> DataFrame:
    """A stream of message values as strings, with ``key, ts, partition`` if ``metadata``.  The connector is a session's package."""
    stream = spark.readStream.format(fmt).options(**options).load()
    if fmt != "kafka":
        return stream
    value = F.col("value").cast("string").alias("value")
    return stream.select(F.col("key").cast("string").alias("key"), value, F.col("timestamp").alias("ts"), "partition") if metadata else stream.select(value)


def positions(df: DataFrame, col: str = "value") -> DataFrame:
    """``track, lat, lon, ts`` from lines ``track \\t lat \\t lon \\t ts``; malformed ones are dropped."""
    from rillflow.functions import geo

    parts = F.split(col, "\t", 2)
    parsed = df.select(F.get(parts, F.lit(0)).alias("track"), geo.parse_position(F.get(parts, F.lit(1))).alias("p"))
    return parsed.where("p is not null").select("track", "p.*")


def sequence(spark: SparkSession, start: int, end: int, every_ms: int, origin_ms: int = 0) -> DataFrame:
    """Numbers with event times ``every_ms`` apart."""
    return spark.range(start, end).withColumn("ts", F.timestamp_millis((F.col("id") - start) * every_ms + origin_ms))


def ticks(spark: SparkSession, per_second: int = 1) -> DataFrame:
    """An unbounded stream of ``timestamp, value``."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load()


def impulse(spark: SparkSession) -> DataFrame:
    """One empty element: ``value``."""
    return spark.range(1).select(F.lit("").alias("value"))


def periodic_impulse(spark: SparkSession, start_ms: int, stop_ms: int, every_ms: int) -> DataFrame:
    """An element ``ts`` at the start and every ``every_ms`` after it, up to and with the stop."""
    return spark.range(start_ms, stop_ms + 1, every_ms).select(F.timestamp_millis("id").alias("ts"))


def counting(spark: SparkSession, **options) -> DataFrame:
    """A stream of numbers ``i`` from ``start``, ``per_batch`` a micro-batch, to ``stop`` if given."""
    from rillflow.sources.ranges import CountingStream

    spark.dataSource.register(CountingStream)
    return spark.readStream.format("counting").options(**{k: str(v) for k, v in options.items()}).load()


def random_scores(spark: SparkSession, names: list[str], n: int, seed: int = 0) -> DataFrame:
    pick = F.element_at(F.array(*[F.lit(x) for x in names]), (F.rand(seed) * len(names)).cast("int") + 1)
    return spark.range(n).select(pick.alias("name"), (F.rand(seed + 1) * 100).cast("int").alias("score"))


def transactions(spark: SparkSession, n: int, users: int = 2000, seed: int = 0) -> DataFrame:
    """Random purchases as a load generator sends them: uid, item, price from 1 to 20, id, epoch ms."""
    at = F.lit(1_704_067_200_000) + F.col("id") * 50
    return spark.range(n).select(
        F.concat(F.lit("uid_"), (F.rand(seed) * users + 1).cast("int")).alias("uid"), F.concat(F.lit("item_"), (F.rand(seed + 1) * 100).cast("int")).alias("item"),
        (F.rand(seed + 2) * 20 + 1).cast("int").cast("double").alias("price"), F.sha1(F.col("id").cast("string").cast("binary")).alias("transaction_id"), at.alias("transaction_ts"),
    )


def script(spark: SparkSession, folder: str, batches: Iterable[list[tuple]], schema: str, first: int = 0) -> DataFrame:
    """A stream that gives each list of rows as one micro-batch (a file each, in order, numbered from ``first``)."""
    import os
    import time

    for i, rows in enumerate(batches, first):
        tmp = f"{folder}/.tmp-{i}"
        spark.createDataFrame(rows, schema).coalesce(1).write.json(tmp, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
        part = next(x for x in os.listdir(tmp) if x.startswith("part-"))
        os.rename(f"{tmp}/{part}", f"{folder}/b{i:05}.json")
        os.utime(f"{folder}/b{i:05}.json", (time.time() - 1000 + i,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{folder}/b*.json")


def epoch(ms: int) -> dt.datetime:
    return dt.datetime.fromtimestamp(ms / 1000, dt.timezone.utc)
