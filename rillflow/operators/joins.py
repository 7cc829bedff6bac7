"""Joins and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cogroup_join(left: DataFrame, right: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """Every row of ``left`` with the only row of its key in ``right``; ``strict`` fails where a key has more than one."""
    if strict:
        only = right.groupBy(key).agg(F.count(F.lit(1)).alias("rf_n"), *[F.first(c).alias(c) for c in right.columns if c != key])
        right = only.where(F.assert_true(F.col("rf_n") == 1, "more than one row of a key").isNull()).drop("rf_n")
    return left.join(right, key)


def lookup_or_default(df: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    """``value`` from a table, or a default.  The planner broadcasts the table if its size, known or measured at run time, allows."""
    joined = df.join(table.select(key, value), key, "left")
    return joined.withColumn(value, F.coalesce(value, F.lit(default)))


def window_side_join(main: DataFrame, side: DataFrame, side_size_ms: int, keys: list[str] = ()) -> DataFrame:
    """Main windows with the side window that holds their last millisecond.  The side window's start is computed,
    so this is an equi-join; ``side`` has ``window_start`` and comes out with ``side_`` before its other columns."""
    at = F.unix_millis(F.col("window_end").cast("timestamp")) - 1
    start = F.timestamp_millis(at - F.pmod(at, F.lit(side_size_ms)))
    named = side.select(F.col("window_start").cast("timestamp").alias("rf_start"), *keys, *[F.col(c).alias(f"side_{c}") for c in side.columns if c not in (*keys, "window_start", "window_end")])
    return main.withColumn("rf_start", start).join(named, ["rf_start", *keys]).drop("rf_start")


def as_of(df: DataFrame, states: DataFrame, key: str, ts: str = "ts", value: str = "value") -> DataFrame:
    """Each row with the latest state of its key at or before its time (a slowly changing side input).

    Of states of one time the greatest counts.  The latest state is carried over hours, so
    a key may hold any share of the rows.
    """
    from rillflow.operators import panes

    seen = states.select(key, ts, F.struct(F.col(ts).alias("at"), F.col(value).alias("state")).alias("rf_state")).withColumn("rf_row", F.lit(0))
    both = df.withColumn("rf_row", F.lit(1)).unionByName(seen, allowMissingColumns=True)
    last = panes.running(both, ts, {"rf_last": panes.running_max("rf_state")}, ties=["rf_row"], keys=[key])
    return last.where("rf_row = 1").select(*df.columns, F.col("rf_last.state").alias("state"))


def rpc_lookup(df: DataFrame, col: str, client, out: str, out_type: str, batch: int = 100) -> DataFrame:
    """``out`` from a remote service: ``client()`` gives a function from a list of distinct values to their results,
    opened once per partition and called with at most ``batch`` values at a time; results fan back to every row."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField(out, T._parse_datatype_string(out_type))])

    def run(batches):
        call = client()
        try:
            for pdf in batches:
                values = list(dict.fromkeys(pdf[col].dropna()))
                known = {}
                for i in range(0, len(values), batch):
                    part = values[i : i + batch]
                    known |= dict(zip(part, call(part)))
                yield pdf.assign(**{out: pdf[col].map(known)})
        finally:
            getattr(call, "close", lambda: None)()

    return df.mapInPandas(run, schema)


def with_scalar(df: DataFrame, scalar: DataFrame) -> DataFrame:
    """Each row beside the columns of a one-row frame; more than one row is an error, none gives nulls."""
    one = scalar.agg(F.count(F.lit(1)).alias("rf_n"), *[F.first(c).alias(c) for c in scalar.columns])
    return df.join(F.broadcast(one.where(F.assert_true(F.col("rf_n") <= 1, "more than one row of a single value").isNull()).drop("rf_n")))


def scalar_filter(df: DataFrame, scalar: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet a condition with the columns of a one-row frame."""
    return with_scalar(df, scalar).where(condition).select(df.columns)


def repeat_each(df: DataFrame, scalar: DataFrame, times: Column, out: str = "i") -> DataFrame:
    """``times`` rows of each row, numbered from 0 in ``out``; ``times`` may use a one-row frame's columns.  Zero or fewer give none."""
    n = F.greatest(times.cast("int"), F.lit(0))
    return with_scalar(df, scalar).where(n > 0).select(*df.columns, F.explode(F.sequence(F.lit(0), n - 1)).alias(out))


def table_lookup(df: DataFrame, table: DataFrame, key: str, out: dict[str, str]) -> DataFrame:
    """Columns of a table's row of the same key, null where there is none (or the key is null): what point queries with a cache give.

    ``out`` maps new names to the table's.  The key is to be unique there; it is made so
    by the largest row, so that no element is doubled.
    """
    one = table.groupBy(F.col(key).alias("rf_key")).agg(F.max(F.struct(*out.values())).alias("rf_row"))
    joined = df.join(one, F.col(key) == F.col("rf_key"), "left")
    return joined.select(*df.columns, *[F.col(f"rf_row.{old}").alias(new) for new, old in out.items()])


def keyed_side_default(main: DataFrame, side: DataFrame, keys: list[str], value: str, default: float = 0.0) -> DataFrame:
    """``main`` with the side input's value of the same window and key, a default where it has none."""
    named = side.select("window_start", *keys, F.col(value).alias("rf_value"))
    return main.join(named, ["window_start", *keys], "left").withColumn(value, F.coalesce("rf_value", F.lit(default))).drop("rf_value")


def versions(df: DataFrame, ticks: DataFrame, keys: list[str], every: str, ts: str = "ts") -> DataFrame:
    """``tick, keys, n``: what a count of all rows before each tick gives, for ticks ``every`` apart.

    Counted once per interval and carried over, not from the start at each tick.
    """
    from pyspark.sql import Window

    deltas = df.groupBy(F.window(ts, every)["end"].alias("tick"), *keys).agg(F.count(F.lit(1)).alias("rf_n"))
    edge = ticks.agg(F.min("tick").alias("rf_first"))
    dealt = deltas.join(F.broadcast(edge)).withColumn("tick", F.greatest("tick", "rf_first")).groupBy("tick", *keys).agg(F.sum("rf_n").alias("rf_n"))
    grid = dealt.select(*keys).distinct().join(F.broadcast(ticks)).join(dealt, ["tick", *keys], "left")
    so_far = Window.partitionBy(*keys).orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    return grid.select("tick", *keys, F.sum("rf_n").over(so_far).alias("n")).where("n is not null")


def view_entries(main: DataFrame, view: DataFrame, every: str, ts: str = "at") -> DataFrame:
    """Every main element beside all entries of the view whose window holds it."""
    return main.withColumn("tick", F.window(ts, every)["start"]).join(view, "tick")
