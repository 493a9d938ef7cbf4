"""Streams drained to their end against the batch operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import tidemark.operators as ops
from tidemark import streaming
from tidemark.functions.aggregates import Agg

T0 = dt.datetime(2024, 5, 1)


@pytest.fixture
def data(spark, tmp_path):
    r = random.Random(9)
    rows = [(T0 + dt.timedelta(seconds=i * 20 + r.randint(0, 15)), r.choice("ab"), float(r.randint(0, 40)), r.choice("xy")) for i in range(400)]
    schema = "ts timestamp_ntz, k string, v double, s string"
    df = spark.createDataFrame(rows, schema)
    for i in range(4):  # four files in time order, rows mixed inside
        part = rows[i * 100 : i * 100 + 100]
        r.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return df, streaming.source(spark, str(tmp_path / "in"), df.schema, 1), max(x[0] for x in rows), tmp_path


def drained(spark, stream, tmp_path, name):
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"c{name}")).trigger(availableNow=True).start(str(tmp_path / name))
    q.awaitTermination(120)
    return spark.read.schema(stream.schema).parquet(str(tmp_path / name))


def test_live_buckets(spark, data):
    df, stream, last, tmp = data
    aggs = [Agg("count", None, "n"), Agg("sum", "v", "t"), Agg("spread", "v", "sp")]
    got = {(r.k, r.window_start.replace(tzinfo=None)): (r.n, r.t, r.sp) for r in drained(spark, streaming.live_buckets(stream, "ts", "10m", aggs, ["k"], "1 hour"), tmp, "b").collect()}
    want = {(r.k, r.bucket): (r.n, r.t, r.sp) for r in ops.sample_by(df, "ts", "10m", aggs, ["k"]).collect() if r.bucket + dt.timedelta(minutes=10) <= last - dt.timedelta(hours=1)}
    assert got == want and got


def test_live_sessions(spark, data):
    df, stream, last, tmp = data
    n = [Agg("count", None, "n")]
    got = {(r.k, r.window_start.replace(tzinfo=None), r.n) for r in drained(spark, streaming.live_sessions(stream, "ts", "61s", n, ["k"], "1 hour"), tmp, "s").collect()}
    want = {(r.k, r.window_start, r.n) for r in ops.session(df, "ts", "61s", n, ["k"]).collect() if r.window_end + dt.timedelta(seconds=61) <= last - dt.timedelta(hours=1)}
    assert got == want and got


def test_live_event_and_state_windows(spark, data):
    df, stream, last, tmp = data
    n = [Agg("count", None, "n"), Agg("sum", "v", "total")]
    got = {(r.k, r.window_start.replace(tzinfo=None), r.n, r.total) for r in drained(spark, streaming.event_windows(stream, "ts", "v", F.col("v") > 30, F.col("v") < 8, ["k"], "1 hour"), tmp, "e").collect()}
    want = {(r.k, r.window_start, r.n, r.total): r.window_end for r in ops.event_window(df, "ts", F.col("v") > 30, F.col("v") < 8, n, ["k"], ["v"]).collect()}
    assert got and got <= set(want) and all(end > last - dt.timedelta(hours=1, minutes=2) for k, end in want.items() if k not in got)
    got = {(r.k, r.window_start.replace(tzinfo=None), r.state, r.n) for r in drained(spark, streaming.state_windows(stream, "ts", "v", "s", ["k"], "1 hour"), tmp, "t").collect()}
    want = {(r.k, r.window_start, r.s, r.n): r.window_end for r in ops.state_window(df, "ts", "s", n, ["k"], ["v"]).collect()}
    assert got and got <= set(want) and all(end > last - dt.timedelta(hours=1, minutes=5) for k, end in want.items() if k not in got)


def test_subscribe_and_forward(spark, data):
    df, stream, _, tmp = data
    assert drained(spark, streaming.subscribe(stream, "k", "a"), tmp, "f").count() == df.where("k = 'a'").count()
    with pytest.raises(ValueError):
        streaming.subscribe(stream, "nope", 1)
    f = streaming.Forwarder(str(tmp / "second"))
    q = stream.writeStream.foreachBatch(f).option("checkpointLocation", str(tmp / "forward-state")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    f(df.limit(0), 99)
    assert spark.read.parquet(str(tmp / "second")).count() == df.count()
