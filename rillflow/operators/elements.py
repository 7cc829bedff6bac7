"""Element-wise operators: projection, filter, flat-map, formatting, parsing, sampling, set operations."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.functions import text


def words(df: DataFrame, col: str = "text", separator: str = text.LETTER, keep: list[str] = ()) -> DataFrame:
    """One row per token, ``word``, beside the columns ``keep``."""
    return df.select(*keep, F.explode(text.tokens(F.col(col), separator)).alias("word"))


def word_index(df: DataFrame, key: str, col: str = "text") -> DataFrame:
    """``key, i, word`` for every blank-separated word of a text, from 0."""
    return df.select(key, F.posexplode(F.split(col, " ")).alias("i", "word"))


def typed_rows(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Named columns cast to the given types; rows with a value missing or not of its type are dropped."""
    return df.select(*[F.col(c).try_cast(t).alias(c) for c, t in types.items()]).dropna()


def parse_json(df: DataFrame, col: str, schema: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with the parsed fields, and the rows that don't parse or lack a required field (dead letters)."""
    parsed = df.withColumn("rf_json", F.from_json(col, schema))
    ok = reduce(lambda a, b: a & b, [F.col(f"rf_json.{c}").isNotNull() for c in required], F.col("rf_json").isNotNull())
    good = parsed.where(ok).select(*df.columns, "rf_json.*")
    return good, parsed.where(~ok).drop("rf_json")


def count_dead_letters(df: DataFrame, col: str, schema: str, required: list[str]) -> DataFrame:
    """One row ``good, bad``: how many rows :func:`parse_json` takes and how many it rejects, in one pass."""
    good, _ = parse_json(df.select(F.col(col).alias("rf_text")), "rf_text", schema, required)
    return df.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(good.agg(F.count(F.lit(1)).alias("good")))).select("good", (F.col("n") - F.col("good")).alias("bad"))


def snake(name: str) -> str:
    """``transactionId`` -> ``transaction_id``."""
    return re.sub(r"(?<=[a-z0-9])([A-Z])", lambda m: "_" + m[1].lower(), name)


def to_json_rows(df: DataFrame, cols: list[str], out: str = "json", snake_case: bool = False) -> DataFrame:
    """Columns as a JSON object; a null field is left out."""
    return df.select(F.to_json(F.struct(*[F.col(c).alias(snake(c) if snake_case else c) for c in cols])).alias(out))


def with_key(df: DataFrame, key, out: str = "key") -> DataFrame:
    """``df`` under one constant key."""
    return df.select(F.lit(key).alias(out), *[F.col(c) for c in df.columns if c != out])


def swapped(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Key and value in each other's place."""
    return df.withColumns({key: F.col(value), value: F.col(key)})


def char_pairs(df: DataFrame, col: str) -> DataFrame:
    """Each text beside every position of it, from 0; an empty or null text gives nothing."""
    return df.where(F.length(col) > 0).select(col, F.explode(F.sequence(F.lit(0), F.length(col) - 1)).alias("i"))


def text_chunks(df: DataFrame, key: str, col: str = "text", size: int = 1 << 20) -> DataFrame:
    """``key, chunk, content``: a text in pieces of ``size`` code points, the last one shorter."""
    n = F.ceil(F.length(col) / size).cast("int")
    parts = df.where(F.length(col) > 0).select(key, col, F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    return parts.select(key, "chunk", F.substring(F.col(col), F.col("chunk") * size + 1, F.lit(size)).alias("content"))


def line_offsets(df: DataFrame, key: str, col: str = "text") -> DataFrame:
    """``key, start, line``: lines with the place of their first code point.  ``key`` is unique."""
    lines = F.transform(F.split(col, "\n", -1), lambda x: F.struct(F.length(x).alias("n"), x.alias("line")))
    parts = df.select(key, F.posexplode(lines).alias("rf_i", "rf_x"))
    before = Window.partitionBy(key).orderBy("rf_i").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(key, F.coalesce(F.sum(F.col("rf_x.n") + 1).over(before), F.lit(0)).alias("start"), F.col("rf_x.line").alias("line"))


def sample_per_key(df: DataFrame, key: str, n: int, order: list[str | Column]) -> DataFrame:
    """``n`` rows of each key, the first in ``order`` (a hash of the row for a random-like, repeatable sample)."""
    return df.withColumn("rf_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rf_rank") <= n).drop("rf_rank")


def tagged(df: DataFrame, tags: dict[str, Column], otherwise: str) -> DataFrame:
    """``df`` with a column ``tag``: the first tag whose condition holds.  Several outputs in one scan."""
    tag = reduce(lambda acc, x: acc.when(x[1], x[0]), list(tags.items())[1:], F.when(next(iter(tags.values())), next(iter(tags))))
    return df.withColumn("tag", tag.otherwise(otherwise))


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def rebalance(df: DataFrame, n: int | None = None) -> DataFrame:
    """Even partitions, to spread the work of an expensive next step."""
    return df.repartition(n) if n else df.hint("rebalance")


def slowed(df: DataFrame, millis: int) -> DataFrame:
    """Each element ``millis`` later than the one before it in its partition: a slow reader, for tests.  One partition makes one slow reader."""

    def run(batches):
        import time

        for batch in batches:
            for i in range(batch.num_rows):
                time.sleep(millis / 1000)
                yield batch.slice(i, 1)

    return df.mapInArrow(run, df.schema)


def per_partition(df: DataFrame, open_, process, close, schema: str | T.StructType) -> DataFrame:
    """Batches of each partition through ``process(resource, pandas)``; the resource is opened once per partition and closed even on failure."""

    def run(batches):
        resource = open_()
        try:
            for batch in batches:
                yield process(resource, batch)
        finally:
            close(resource)

    return df.mapInPandas(run, schema)
