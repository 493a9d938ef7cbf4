"""Streaming forms of the batch operators.

Late rows are dropped behind the watermark. Windows close, and are emitted once, when the watermark passes them.
State and event windows need time order inside a key: rows wait in state until the watermark passes them,
then a key's rows up to the watermark are taken in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.aggregates import Agg
from ..operators.buckets import width_micros
from ..shipping import ship


#: The state store that can hold several named states and timers.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def source(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of a table as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def subscribe(stream: DataFrame, column: str | None = None, value: object = None) -> DataFrame:
    """Rows whose column equals value (all without a column)."""
    if column is None:
        return stream
    if column not in stream.columns:
        raise ValueError(f"unknown column {column}")
    return stream.where(F.col(column) == F.lit(value))


def _agg(a: Agg, ts: str) -> Column:
    if a.fn == "count":
        return F.count(F.lit(1)).alias(a.name)
    v = a.value()
    made = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "stddev": F.stddev_pop, "approx_count_distinct": F.approx_count_distinct}
    if a.fn == "spread":
        return (F.max(v) - F.min(v)).alias(a.name)
    if a.fn in ("first", "last", "last_row"):
        return (F.min_by if a.fn == "first" else F.max_by)(v, F.col(ts)).alias(a.name)
    if a.fn not in made:
        raise ValueError(f"{a.fn} is not kept on streams")
    return made[a.fn](v).alias(a.name)


def live_buckets(stream: DataFrame, ts: str, width: str, aggs: Sequence[Agg], keys: Sequence[str] = (), late: str = "0 seconds", slide: str | None = None) -> DataFrame:
    """SAMPLE BY on a stream (or sliding windows)."""
    w = F.window("__ts", f"{width_micros(width)} microseconds", f"{width_micros(slide)} microseconds" if slide else None)
    rows = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    out = rows.groupBy(*keys, w.alias("__w")).agg(*[_agg(a, ts) for a in aggs])
    return out.select(*keys, F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"), *[F.col(f"`{a.name}`") for a in aggs])


def live_sessions(stream: DataFrame, ts: str, gap: str, aggs: Sequence[Agg], keys: Sequence[str], late: str = "0 seconds") -> DataFrame:
    """SESSION on a stream; window_end is the last row's time."""
    g = width_micros(gap)
    rows = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    out = rows.groupBy(*keys, F.session_window("__ts", f"{g} microseconds").alias("__w")).agg(F.max("__ts").alias("window_end"), *[_agg(a, ts) for a in aggs])
    return out.select(*keys, F.col("__w.start").alias("window_start"), "window_end", *[F.col(f"`{a.name}`") for a in aggs])


class _Windows(StatefulProcessor):
    """Holds rows until the watermark passes them, then steps through them in time order. One row of state: the open window."""

    def __init__(self, key_names: list[str], step: Callable):
        self.key_names, self.step = key_names, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, value double, a boolean, b boolean, state string")
        self.open = handle.getValueState("open", "start long, last long, n long, total double, state string")
        self.done = handle.getValueState("done", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            seconds = set()
            for r in pdf.itertuples(index=False):
                self.waiting.appendValue((int(r.us), float(r.value), bool(r.a), bool(r.b), None if r.state is None else str(r.state)))
                seconds.add(int(r.us) // 1_000_000 + 1)
            for s in seconds:  # a timer a second, not a row
                self.handle.registerTimer(s * 1000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        # The first timer that a watermark lets expire takes all rows due; the others don't read the list again.
        if self.done.exists() and self.done.get()[0] >= now:
            return
        self.done.update((now,))
        held = sorted(tuple(x) for x in self.waiting.get())
        due, later = [x for x in held if x[0] < now], [x for x in held if x[0] >= now]
        if not due:
            return
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        window = self.open.get() if self.open.exists() else None
        out = []
        for row in due:
            window, closed = self.step(tuple(window) if window is not None else None, row)
            out += closed
        if window is None:
            self.open.clear()
        else:
            self.open.update(tuple(window))
        if out:
            made = pd.DataFrame([(*key, pd.Timestamp(s, unit="us"), pd.Timestamp(e, unit="us"), n, t, st) for s, e, n, t, st in out], columns=[*self.key_names, "window_start", "window_end", "n", "total", "state"])
            yield made

    def close(self) -> None:
        pass


def _grown(w, row):
    return (w[0], row[0], w[2] + 1, w[3] + row[1], w[4])


def event_step(w, row):
    """Open on a, close with b (maybe the same row)."""
    if w is None:
        if not row[2]:
            return None, []
        w = (row[0], row[0], 0, 0.0, None)
    w = _grown(w, row)
    return (None, [w]) if row[3] else (w, [])


def state_step(w, row):
    if w is not None and w[4] == row[4]:
        return _grown(w, row), []
    return _grown((row[0], row[0], 0, 0.0, row[4]), row), [] if w is None else [w]


def _stateful(stream: DataFrame, ts: str, value: str, keys: Sequence[str], late: str, a: Column, b: Column, state: Column, step: Callable) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    ship(stream.sparkSession)
    rows = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    true = lambda c: F.coalesce(c, F.lit(False))
    rows = rows.select(*keys, "__ts", F.unix_micros("__ts").alias("us"), F.col(value).cast("double").alias("value"), true(a).alias("a"), true(b).alias("b"), state.cast("string").alias("state"))
    schema = T.StructType([*[stream.schema[k] for k in keys], T.StructField("window_start", T.TimestampType()), T.StructField("window_end", T.TimestampType()), T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType()), T.StructField("state", T.StringType())])
    return rows.groupBy(*keys).transformWithStateInPandas(_Windows(list(keys), step), schema, "Append", "EventTime")


def event_windows(stream: DataFrame, ts: str, value: str, start: Column, end: Column, keys: Sequence[str], late: str = "0 seconds") -> DataFrame:
    """EVENT_WINDOW on a stream: keys, window_start, window_end, n, total of value."""
    return _stateful(stream, ts, value, keys, late, start, end, F.lit(None), event_step).drop("state")


def state_windows(stream: DataFrame, ts: str, value: str, state: str, keys: Sequence[str], late: str = "0 seconds") -> DataFrame:
    """STATE_WINDOW on a stream: keys, window_start, window_end, n, total of value, state; a window closes when the next begins."""
    return _stateful(stream, ts, value, keys, late, F.lit(False), F.lit(False), F.col(state), state_step)


def deliver(stream: DataFrame, to: Callable, checkpoint: str, every: str = "10 milliseconds") -> StreamingQuery:
    """Hands a subscription's rows to a function (DataFrame, batch number); rows of one interval come as one batch."""
    return stream.writeStream.foreachBatch(to).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def unsubscribe(query: StreamingQuery) -> None:
    """Ends a subscription after what has arrived is delivered."""
    query.processAllAvailable()
    query.stop()


class Forwarder:
    """Copies every micro-batch to a second place. A batch that is replayed replaces itself, so nothing comes twice."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).start()
