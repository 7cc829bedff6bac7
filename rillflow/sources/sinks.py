"""Sinks: text, one file per window, tables, keyed upsert, message buses, notifications."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_counts(df: DataFrame, path: str, key: str, value: str) -> None:
    """Lines ``key: value``."""
    from rillflow.functions.text import format_count

    df.select(format_count(F.col(key), F.col(value)).alias("value")).write.mode("overwrite").text(path)


def write_window_files(df: DataFrame, path: str, line: str, prefix: str = "output", shards: int = 1) -> list[str]:
    """``shards`` files per window, ``<day>/prefix-HH:mm-HH:mm-<shard>-of-<shards>``; returns their names.

    Rows need ``window_start`` and ``window_end``; a row without them is an error.  Lines
    are dealt by their hash.  Files appear under their names by renames on the driver,
    one for each, after all of them are written.
    """
    bounds = F.concat(F.lit(f"{prefix}-"), F.date_format("window_start", "HH:mm"), F.lit("-"), F.date_format("window_end", "HH:mm"))
    day = F.date_format("window_start", "yyyy-MM-dd")
    named = df.select(F.col(line).alias("value"), F.when(F.assert_true(F.col("window_end").isNotNull(), "rows without a window").isNull(), bounds).alias("window"), day.alias("day"), F.pmod(F.xxhash64(line), F.lit(shards)).alias("shard"))
    spark, held = df.sparkSession, f"{path}/.parts-{uuid.uuid4().hex}"
    named.repartition("day", "window", "shard").write.partitionBy("day", "window", "shard").text(held)
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs, names = at(path).getFileSystem(spark._jsc.hadoopConfiguration()), []
    if fs.getScheme() == "file":
        fs = fs.getRawFileSystem()  # checksum files can't have a colon in their names
    files = spark.read.text(held).select(F.col("_metadata.file_path").alias("f"), "day", "window", "shard").distinct().collect() if named.limit(1).count() else []
    for r in files:
        name = f"{r['day']}/{r['window']}-{r['shard']}-of-{shards}"
        fs.mkdirs(at(f"{path}/{r['day']}"))
        fs.delete(at(f"{path}/{name}"), False)
        fs.rename(at(spark._jvm.java.net.URI(r["f"])), at(f"{path}/{name}"))
        names.append(name)
    fs.delete(at(held), True)
    return sorted(names)


def write_table(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").parquet(path)


def upsert(df: DataFrame, path: str, key: str, order: str | None = None, tries: int = 3) -> int:
    """Rows of ``df`` replace those of the same key in the table at ``path``; returns the new version, which :func:`read_upserted` gives.

    Each version is a folder and a pointer to it, numbered one higher than the last.  The
    pointer is written last and never replaced, so a call that fails anywhere leaves the
    version before whole, and of two calls at once one fails and is tried again on top of
    the other, ``tries`` times in all.  The returned number is the signal that all is stored.
    """
    spark = df.sparkSession
    latest = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order or F.xxhash64(*df.columns)).alias("r")).select("r.*")
    for left in range(tries - 1, -1, -1):
        try:
            before, new = _version(spark, path), latest
            if before:
                old = spark.read.parquet(f"{path}/{before[1]}")
                new = new.unionByName(old.join(new, key, "left_anti"))
            folder, n = f"v-{uuid.uuid4().hex}", before[0] + 1 if before else 1
            new.write.parquet(f"{path}/{folder}")
            spark.createDataFrame([(folder,)], "value string").coalesce(1).write.text(f"{path}/at/n={n}")
            return n
        except Exception:
            if not left:
                raise
    raise ValueError("tries has to be 1 at least")


def _version(spark, path: str) -> tuple[int, str] | None:
    """Number and folder of the version with the highest pointer."""
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.text(f"{path}/at").orderBy(F.desc(F.col("n").cast("long"))).first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    return None if found is None else (int(found["n"]), found["value"])


def read_upserted(spark, path: str) -> DataFrame:
    """The current version of a table that :func:`upsert` writes."""
    found = _version(spark, path)
    if found is None:
        raise ValueError(f"no version at {path}")
    return spark.read.parquet(f"{path}/{found[1]}")


def wait_on(signals, start):
    """``start()`` after all of ``signals`` (functions, such as a load that returns when its rows are stored) have come back."""
    for signal in signals:
        signal()
    return start()


def write_stream(df: DataFrame, checkpoint: str, sink, trigger: dict | None = None, mode: str = "append"):
    """``sink(batch, batch_id)`` for every micro-batch; for a message bus it writes with the bus's format."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def write_values(df: DataFrame, col: str, fmt: str = "kafka", **options: str) -> None:
    """A column of any type as message values, written as its text; a null is a message without a value."""
    df.select(F.col(col).cast("string").alias("value")).write.format(fmt).options(**options).save()


def bus_sink(fmt: str = "kafka", **options: str):
    return lambda batch, _: batch.write.format(fmt).options(**options).save()


def notifications(df: DataFrame, key: str = "track", faster: str = "faster") -> DataFrame:
    """``key, value``: the user is what stands before ``:`` in the key."""
    user = F.substring_index(key, ":", 1)
    # The two messages.
    message = F.when(F.col(faster), "Great job! You are gaining speed.").otherwise("Looks like you are slowing down. Go! Go! Go!")
    return df.select(user.alias("key"), message.alias("value"))


def tap(df: DataFrame, name: str, **metrics) -> DataFrame:
    """``df`` unchanged, with metrics observed on the way (read them from an ``Observation`` or a query listener)."""
    return df.observe(name, *[v.alias(k) for k, v in metrics.items()])
