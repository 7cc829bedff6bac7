"""Structured Streaming: windowed aggregates, late routing, and processors with state and timers.

Filters that don't touch the event time stand after stateful operators: pushed below
the watermark they would keep rows from advancing it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def windowed(df: DataFrame, keys: list[str], aggs: list[Column], size: str, every: str | None = None, lateness: str = "0 seconds", ts: str = "ts") -> DataFrame:
    """Windowed aggregates of a stream (or a batch), flat."""
    w = F.window(ts, size, every) if every else F.window(ts, size)
    out = df.withWatermark(ts, lateness).groupBy(w, *keys).agg(*aggs)
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in out.columns if c != "window"])


class LateRouter:
    """A ``foreachBatch`` sink that sends rows of closed windows to ``droppable`` and the others to ``main``.

    The watermark is the latest event time of earlier batches.  It is stored in the folder
    ``state`` (to be kept beside the checkpoint) under each batch's id after the batch, so
    a restart goes on with it, and a batch that is done again is split as before.
    """

    def __init__(self, main: Callable, droppable: Callable, size: str, lateness: str, state: str, ts: str = "ts") -> None:
        self.main, self.droppable, self.size, self.lateness, self.state, self.ts = main, droppable, size, lateness, state, ts

    def _mark(self, spark: SparkSession, batch_id: int):
        from pyspark.errors import AnalysisException

        try:
            found = spark.read.schema("top timestamp, batch long").parquet(self.state).where(F.col("batch") < batch_id)
            return found.agg(F.max("top")).first()[0]
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, held = batch.sparkSession, batch.persist()
        try:
            mark = self._mark(spark, batch_id)
            end = F.window(self.ts, self.size)["end"] + F.expr(f"interval {self.lateness}")
            late = F.lit(False) if mark is None else end <= F.lit(mark)
            self.main(held.where(~late), batch_id)
            self.droppable(held.where(late), batch_id)
            # one small row a batch; those before the last need not be kept
            top = held.agg(F.greatest(F.max(self.ts).cast("timestamp"), F.lit(mark).cast("timestamp")).alias("top"))
            top.coalesce(1).write.mode("overwrite").parquet(f"{self.state}/batch={batch_id}")
        finally:
            held.unpersist()


class CountBuffer(StatefulProcessor):
    """Values of a key in batches of ``size``: rows ``key, value``, emitted together when the buffer is full."""

    def __init__(self, size: int) -> None:
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buffer = handle.getListState("buffer", "value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = [r[0] for r in self.buffer.get()] if self.buffer.exists() else []
        for r in rows:
            held.append(r["value"])
            if len(held) == self.size:
                yield from (Row(key=key[0], value=v) for v in held)
                held = []
        self.buffer.clear()
        if held:
            self.buffer.put([(v,) for v in held])

    def close(self) -> None:
        pass


class TimedBatcher(StatefulProcessor):
    """Batches per key, flushed at ``size`` values or ``wait_ms`` after the first: rows ``key, values`` in time order.

    Input rows have ``value`` and ``at`` (ms).  The timer runs in the query's time mode.
    """

    def __init__(self, size: int, wait_ms: int, processing_time: bool = False) -> None:
        self.size, self.wait_ms, self.processing_time = size, wait_ms, processing_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", "at long, value string")
        self.due = handle.getValueState("due", "due long")

    def _flush(self, key, held) -> Row:
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()
        return Row(key=key[0], values=[v for _, v in sorted(held)])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = [tuple(r) for r in self.buffer.get()] if self.buffer.exists() else []
        for r in sorted(rows, key=lambda r: r["at"]):
            held.append((r["at"], r["value"]))
            if len(held) == self.size:
                yield self._flush(key, held)
                held = []
            elif len(held) == 1:
                due = (timerValues.getCurrentProcessingTimeInMs() if self.processing_time else r["at"]) + self.wait_ms
                self.handle.registerTimer(due)
                self.due.update((due,))
        self.buffer.clear()
        if held:
            self.buffer.put(held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = [tuple(r) for r in self.buffer.get()] if self.buffer.exists() else []
        self.buffer.clear()
        if held:
            yield self._flush(key, held)

    def close(self) -> None:
        pass


class LoopingTimer(StatefulProcessor):
    """A tick per key: ``first_ms`` after its first row, then every ``every_ms`` of event time up to ``stop_ms``."""

    def __init__(self, first_ms: int, every_ms: int, stop_ms: int) -> None:
        self.first_ms, self.every_ms, self.stop_ms = first_ms, every_ms, stop_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.started = handle.getValueState("started", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = min(r["at"] for r in rows)
        if not self.started.exists():
            self.started.update((first,))
            self.handle.registerTimer(first + self.first_ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if at + self.every_ms <= self.stop_ms:
            self.handle.registerTimer(at + self.every_ms)
        yield Row(key=key[0], tick=at)

    def close(self) -> None:
        pass


class RunningValue(StatefulProcessor):
    """Each purchase with its user's running total and count: rows ``key, price, total, cnt``.

    Seeds come as the query's initial state (``total`` and ``cnt`` beside the key), which
    Spark deals to the keys' tasks; no task holds all of them.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", "total double, cnt long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        seed = initialState if isinstance(initialState, Row) else next(iter(initialState))
        self.value.update((float(seed["total"]), int(seed["cnt"])))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        total, cnt = self.value.get() if self.value.exists() else (0.0, 0)
        for r in sorted(rows, key=lambda r: r["at"]):
            total, cnt = total + r["price"], cnt + 1
            yield Row(key=key[0], price=r["price"], total=total, cnt=cnt)
        self.value.update((total, cnt))

    def close(self) -> None:
        pass


class DelayedPanes(StatefulProcessor):
    """Panes that fire ``wait_ms`` after the first element of each, in the query's time mode: rows ``key, pane, total``.

    Input rows have ``value`` (a number) and ``at`` (ms); ``pane`` counts from 0.  ``accumulating``
    totals run on from pane to pane, others start anew.
    """

    def __init__(self, wait_ms: int, accumulating: bool = True, processing_time: bool = False) -> None:
        self.wait_ms, self.accumulating, self.processing_time = wait_ms, accumulating, processing_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "pane long, total long, open boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        pane, total, open_ = self.state.get() if self.state.exists() else (0, 0, False)
        for r in sorted(rows, key=lambda r: r["at"]):
            if not open_:
                now = timerValues.getCurrentProcessingTimeInMs() if self.processing_time else r["at"]
                self.handle.registerTimer(now + self.wait_ms)
                open_ = True
            total += r["value"]
        self.state.update((pane, total, open_))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        pane, total, _ = self.state.get()
        self.state.update((pane + 1, total if self.accumulating else 0, False))
        yield Row(key=key[0], pane=pane, total=total)

    def close(self) -> None:
        pass


class ExpiringWindow(StatefulProcessor):
    """Counts per window, put out once when the window has expired: rows ``key, window_end, n``.

    Input rows have ``at`` (ms).  A window expires when the watermark passes its end and
    the lateness; what comes for it later is dropped.  The place for a window's last words.
    """

    def __init__(self, size_ms: int, lateness_ms: int) -> None:
        self.size_ms, self.lateness_ms = size_ms, lateness_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "window_end long", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        for r in rows:
            end = r["at"] - r["at"] % self.size_ms + self.size_ms
            if end + self.lateness_ms <= now:
                continue
            if self.counts.containsKey((end,)):
                self.counts.updateValue((end,), (self.counts.getValue((end,))[0] + 1,))
            else:
                self.counts.updateValue((end,), (1,))
                self.handle.registerTimer(end + self.lateness_ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        end = expiredTimerInfo.getExpiryTimeInMs() - self.lateness_ms
        n = self.counts.getValue((end,))[0]
        self.counts.removeKey((end,))
        yield Row(key=key[0], window_end=end, n=n)

    def close(self) -> None:
        pass


def stateful(df: DataFrame, key: str, processor: StatefulProcessor, schema: str, time_mode: str = "eventTime", mode: str = "append", initial: DataFrame | None = None) -> DataFrame:
    """``initial`` has the key's column and the processor's seed beside it, one row a key."""
    seeds = None if initial is None else initial.groupBy(key)
    return df.groupBy(key).transformWithState(statefulProcessor=processor, outputStructType=schema, outputMode=mode, timeMode=time_mode, initialState=seeds)
