"""Operators on small series with results worked by hand, and blocks against one block on random series."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import tidemark.operators as ops
from tidemark import order
from tidemark.functions.aggregates import Agg, aggregate
from tidemark.functions.percentiles import exact_percentiles
from tidemark.operators import stable

T0 = dt.datetime(2024, 3, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def series(spark, points, columns="ts timestamp_ntz, v double"):
    return spark.createDataFrame([(at(t), *rest) for t, *rest in points], columns).repartition(3)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns[:1])).collect()]


BLOCKS = [1, 3]


@pytest.mark.parametrize("blocks", BLOCKS)
def test_session(spark, blocks):
    df = series(spark, [(0, 1.0), (1, 2.0), (2, 3.0), (10, 4.0), (11, 5.0)])
    got = ops.session(df, "ts", "3s", [Agg("avg", "v", "a"), Agg("count", None, "n")], blocks=blocks)
    assert [(r.a, r.n, r.window_start, r.window_end) for r in got.orderBy("window_start").collect()] == [(2.0, 3, at(0), at(2)), (4.5, 2, at(10), at(11))]
    assert ops.session(df, "ts", "8s", [Agg("count", None, "n")], blocks=blocks).count() == 1  # an equal gap stays
    assert ops.session(df.limit(0), "ts", "8s", [Agg("count", None, "n")], blocks=blocks).count() == 0


@pytest.mark.parametrize("blocks", BLOCKS)
def test_state(spark, blocks):
    df = series(spark, [(i, s) for i, s in enumerate([1, 1, 2, 2, 1, 3])], "ts timestamp_ntz, s int")
    got = ops.state_window(df, "ts", "s", [Agg("count", None, "n")], blocks=blocks)
    assert [r.n for r in got.orderBy("window_start").collect()] == [2, 2, 1, 1]
    nulls = series(spark, [(0, None), (1, None), (2, 1), (3, None)], "ts timestamp_ntz, s int")
    assert sorted(r.n for r in ops.state_window(nulls, "ts", "s", [Agg("count", None, "n")], blocks=blocks).collect()) == [1, 1, 2]


@pytest.mark.parametrize("blocks", BLOCKS)
def test_event(spark, blocks):
    df = series(spark, [(i, float(v)) for i, v in enumerate([10, 15, 25, 30, 20, 8, 12, 28])])
    got = ops.event_window(df, "ts", F.col("v") > 20, F.col("v") < 15, [Agg("avg", "v", "a"), Agg("count", None, "n")], blocks=blocks)
    assert [(r.window_start, r.a, r.n) for r in got.orderBy("window_start").collect()] == [(at(2), 20.75, 4), (at(7), 28.0, 1)]
    same = series(spark, [(0, 1, 5.0), (0, 2, 50.0), (0, 3, 1.0), (1, 4, 30.0)], "ts timestamp_ntz, id int, v double")
    got = ops.event_window(same, "ts", F.col("v") > 20, F.col("v") < 15, [Agg("count", None, "n")], tie=["id"], blocks=blocks)
    assert sorted(r.n for r in got.collect()) == [1, 2]


@pytest.mark.parametrize("blocks", BLOCKS)
def test_row_functions(spark, blocks):
    df = series(spark, [(i, float(i)) for i in range(10)])
    assert [r[0] for r in rows(ops.diff(df, "ts", "v", "d", blocks=blocks).select("d", "ts"), "ts")] == [None] + [1.0] * 9
    assert [r[0] for r in rows(ops.csum(df, "ts", "v", "c", blocks=blocks).select("c", "ts"), "ts")] == [i * (i + 1) / 2 for i in range(10)]
    assert [r[0] for r in rows(ops.mavg(df, "ts", "v", 3, "m", blocks=blocks).select("m", "ts"), "ts")] == [0, 0.5, 1, 2, 3, 4, 5, 6, 7, 8]
    assert [r[0] for r in rows(ops.lag(df, "ts", "v", 4, "l", blocks=blocks).select("l", "ts"), "ts")] == [None] * 4 + [0, 1, 2, 3, 4, 5]
    odd = series(spark, [(0, 0.0), (2, 6.0), (5, 12.0), (5, 13.0)])
    assert [r[0] for r in rows(ops.derivative(odd, "ts", "v", "d", tie=["v"], blocks=blocks).select("d", "ts", "v"), "ts", "v")] == [None, 3.0, 2.0, 0.0]
    with pytest.raises(ValueError):
        ops.mavg(df, "ts", "v", 65, "m")


@pytest.mark.parametrize("blocks", BLOCKS)
def test_interp(spark, blocks):
    one = lambda p, w="1s": [r[0] for r in rows(ops.interp(series(spark, p), "ts", "v", w, blocks=blocks).select("v", "ts"), "ts")]
    assert one([(0, 0.0), (2, 2.0), (4, 4.0)]) == [0, 1, 2, 3, 4]
    assert one([(0, 0.0), (5, 10.0)]) == [0, 2, 4, 6, 8, 10]
    assert one([(0, 0.0)]) == []
    assert one([(0.5, 0.0), (2.5, 2.0)]) == [0.5, 1.5]
    assert one([(0, 1.0), (0, 7.0), (2, 3.0)]) == [7.0, 5.0, 3.0]  # the last of one instant


def test_twa(spark):
    assert aggregate(series(spark, [(i, float(i + 1)) for i in range(100)]), [Agg("twa", "v", "w")], ts="ts").first()[0] == pytest.approx(51.0)
    df = series(spark, [(0, 0.0), (100, 10.0), (1000, 100.0)])
    for blocks in BLOCKS:
        assert aggregate(df, [Agg("twa", "v", "w")], ts="ts", blocks=blocks).first()[0] == pytest.approx(91.0)
    assert aggregate(series(spark, [(3, 8.0)]), [Agg("twa", "v", "w")], ts="ts").first()[0] == 8.0
    assert aggregate(series(spark, [(3, 8.0), (3, 9.0)]), [Agg("twa", "v", "w")], ts="ts", tie=["v"]).first()[0] == 9.0
    assert aggregate(df.limit(0), [Agg("twa", "v", "w"), Agg("count", None, "n"), Agg("sum", "v", "s")], ts="ts").first().asDict() == {"w": None, "n": 0, "s": None}


def test_aggregates_of_nulls_and_ties(spark):
    df = series(spark, [(0, 5.0), (0, 3.0), (9, None), (9, 4.0)])
    got = aggregate(df, [Agg("first", "v", "f"), Agg("last", "v", "l"), Agg("count", "v", "n"), Agg("spread", "v", "s"), Agg("p50", "v", "m"), Agg("p50", "v", "ma", approx=True)], ts="ts", tie=["v"]).first()
    assert (got.f, got.l, got.n, got.s, got.m, got.ma) == (3.0, 4.0, 3, 2.0, 4.0, 4.0)
    with pytest.raises(ValueError):
        aggregate(df, [Agg("median", "v", "m")])


def test_sample_by_before_1970_and_fill(spark):
    df = spark.createDataFrame([(dt.datetime(1969, 12, 31, 23, 59, 59), 1.0), (dt.datetime(1970, 1, 1, 0, 0, 3), 5.0)], "ts timestamp_ntz, v double")
    one = lambda how: [r.a for r in ops.sample_by(df, "ts", "1s", [Agg("sum", "v", "a")], how=how).orderBy("bucket").collect()]
    assert one(None) == [1.0, 5.0] and one("prev") == [1.0, 1.0, 1.0, 1.0, 5.0] and one("null") == [1.0, None, None, None, 5.0]
    assert one(-2) == [1.0, -2.0, -2.0, -2.0, 5.0] and one("linear") == [1.0, 2.0, 3.0, 4.0, 5.0]
    assert ops.sample_by(df, "ts", "1m", [Agg("count", None, "n")]).orderBy("bucket").first().bucket == dt.datetime(1969, 12, 31, 23, 59)
    with pytest.raises(ValueError):
        ops.sample_by(df, "ts", "1s", [])
    with pytest.raises(ValueError):
        one("cubic")


@pytest.mark.parametrize("blocks", BLOCKS)
def test_asof(spark, blocks):
    q = series(spark, [(50, "AAPL", 9.0), (100, "AAPL", 9.5), (200, "AAPL", 9.8), (10, "MSFT", None)], "ts timestamp_ntz, sym string, bid double")
    t = series(spark, [(30, "AAPL"), (80, "AAPL"), (120, "AAPL"), (250, "AAPL"), (50, "AAPL"), (11, "MSFT"), (300, None)], "ts timestamp_ntz, sym string")
    got = {(r.ts, r.sym): (r.bid, r.r_ts) for r in ops.asof_join(t, q, "ts", "ts", ["sym"], blocks=blocks).collect()}
    assert got == {(at(30), "AAPL"): (None, None), (at(80), "AAPL"): (9.0, at(50)), (at(120), "AAPL"): (9.5, at(100)), (at(250), "AAPL"): (9.8, at(200)), (at(50), "AAPL"): (9.0, at(50)), (at(11), "MSFT"): (None, at(10)), (at(300), None): (None, None)}
    assert [r.bid for r in ops.asof_join(t, q.limit(0), "ts", "ts", ["sym"], blocks=blocks).collect()] == [None] * 7
    assert ops.asof_join(t.limit(0), q, "ts", "ts", ["sym"], blocks=blocks).count() == 0
    ties = series(spark, [(5, 1, 1.0), (5, 2, 2.0)], "ts timestamp_ntz, id int, bid double")
    assert ops.asof_join(series(spark, [(5, "x")], "ts timestamp_ntz, s string"), ties, "ts", "ts", tie=["id"], blocks=blocks).first().bid == 2.0


def test_latest(spark):
    df = series(spark, [(1, "a", 1), (3, "a", 2), (3, "a", 3), (2, None, 4)], "ts timestamp_ntz, k string, id int")
    assert {r.k: r.id for r in ops.latest_on(df, "ts", ["k"], ["id"]).collect()} == {"a": 3, None: 4}
    assert ops.latest_on(df, "ts", tie=["id"]).first().id == 3 and ops.latest_on(df.limit(0), "ts").count() == 0


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_blocks_change_nothing(spark, keys):
    """Series cut into blocks give what one block gives, with gaps, ties and unequal keys."""
    r = random.Random(4)
    data = [(at(r.randint(0, 400)), r.choice("aaaaaaab"), i, float(r.randint(0, 40)), r.choice("xy")) for i in range(600)]
    df = spark.createDataFrame(data, "ts timestamp_ntz, k string, id int, v double, s string").repartition(4)
    n = [Agg("count", None, "n"), Agg("sum", "v", "t")]
    made = {
        "session": lambda b: ops.session(df, "ts", "1s", n, keys, ["id"], b),
        "state": lambda b: ops.state_window(df, "ts", "s", n, keys, ["id"], b),
        "event": lambda b: ops.event_window(df, "ts", F.col("v") > 35, F.col("v") < 5, n, keys, ["id"], b),
        "mavg": lambda b: ops.mavg(df, "ts", "v", 40, "m", keys, ["id"], b).select("id", F.round("m", 9)),
        "lag": lambda b: ops.lag(df, "ts", "v", 64, "m", keys, ["id"], b).select("id", "m"),
        "csum": lambda b: ops.csum(df, "ts", "v", "m", keys, ["id"], b).select("id", "m"),
        "interp": lambda b: ops.interp(df, "ts", "v", "700ms", None, keys, ["id"], b).select(*keys, "ts", F.round("v", 9)),
        "asof": lambda b: ops.asof_join(df.where("s = 'x'"), df.where("s = 'y'"), "ts", "ts", keys, ["id"], blocks=b).select("id", "r_id"),
        "twa": lambda b: aggregate(df, [Agg("twa", "v", "w")], keys, "ts", ["id"], b).select(*keys, F.round("w", 9)),
    }
    for name, make in made.items():
        one, many = (sorted(map(repr, make(b).collect())) for b in (1, 7))
        assert one == many, name


def test_super_table(spark):
    children = {"d1": series(spark, [(0, 1.0), (1, 2.0), (2, 3.0)]), "d2": series(spark, [(0, 4.0), (1, 5.0)])}
    df = stable.union_children(children, {"d1": {"location": "east", "gid": 42}, "d2": {"location": "west", "gid": 17}})
    assert df.count() == 5 and df.where("location = 'east'").count() == 3
    assert rows(stable.by_child(df, [Agg("count", None, "n")])) == [("d1", 3), ("d2", 2)]


def test_plans_stay_narrow(spark, sf):
    """Latest rows and buckets aggregate before the exchange; filters and columns reach the scan."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    plan = ops.latest_on(e.select("ts", "user_id", "value"), "ts", ["user_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1
    plan = ops.sample_by(e.where("value > 100"), "ts", "1h", [Agg("avg", "value", "a")])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(value,100.0)" in plan and "props" not in plan and plan.count("Exchange") == 1
    keyed = ops.asof_join(e.where("event_type = 'click'"), e.where("event_type = 'view'"), "ts", "ts", ["user_id"])._jdf.queryExecution().executedPlan().toString()
    assert keyed.count("Exchange") == 1 and "Join" not in keyed


def _keyed(spark, n=1800):
    """A hot key with two thirds of the rows, many small ones, null keys, ties and a gap."""
    r = random.Random(11)
    rows = []
    for i in range(n):
        k = "hot" if r.random() < 0.66 else r.choice(["a", "b", "c", None])
        rows.append((T0 + dt.timedelta(seconds=r.randint(0, n) * 7 + (9000 if i % 2 else 0)), i, k, float(r.randint(0, 60)), r.choice("xyz")))
    return spark.createDataFrame(rows, "ts timestamp_ntz, id long, k string, v double, s string")


def _all_windows(df, keys):
    agg = [Agg("count", None, "n"), Agg("sum", "v", "t"), Agg("twa", "v", "w")]
    yield "session", ops.session(df, "ts", "30s", agg, keys, ["id"])
    yield "state", ops.state_window(df, "ts", "s", agg, keys, ["id"])
    yield "event", ops.event_window(df, "ts", F.col("v") > 50, F.col("v") < 5, agg, keys, ["id"])
    yield "lag", ops.lag(df, "ts", "v", 5, "x", keys, ["id"])
    yield "mavg", ops.mavg(df, "ts", "v", 4, "x", keys, ["id"])
    yield "csum", ops.csum(df, "ts", "v", "x", keys, ["id"])
    yield "interp", ops.interp(df, "ts", "v", "20s", keys=keys, tie=["id"])
    left, right = df.where("id % 3 = 0").select("ts", "id", "k"), df.where("id % 3 <> 0").select("ts", "id", "k", "v")
    yield "asof", ops.asof_join(left, right, "ts", "ts", keys, ["id"])


@pytest.mark.parametrize("keys,rows", [([], 25), (["k"], 700)])
def test_blocks_by_rows_change_nothing(spark, keys, rows):
    """Series cut by size (over 64 blocks at 25 rows each), of keyed ones the hot ones only, against whole series."""
    df = _keyed(spark)
    spark.conf.set("spark.tidemark.blocks", "1")
    want = {n: sorted(map(str, map(rounded, d.collect()))) for n, d in _all_windows(df, keys)}
    spark.conf.unset("spark.tidemark.blocks")
    spark.conf.set("spark.tidemark.blockBytes", "0")
    spark.conf.set("spark.tidemark.blockRows", str(rows))
    try:
        cut, cuts = order.with_blocks(df, "ts", keys)
        assert (len(cuts) > 64) == (rows == 25)
        if keys and rows == 700:
            assert {r.k for r in cut.where(F.col(order.BLOCK) != order.WHOLE).select("k").distinct().collect()} == {"hot"}
        for n, d in _all_windows(df, keys):
            assert sorted(map(str, map(rounded, d.collect()))) == want[n], n
    finally:
        spark.conf.unset("spark.tidemark.blockBytes")
        spark.conf.unset("spark.tidemark.blockRows")


def rounded(row):
    return tuple(round(x, 6) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_percentiles_without_value_maps(spark, keys):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), r.choice([1.0, 2.5, r.random() * 1000, r.random()])) for _ in range(5000)] + [("one", 4.0), ("two", 1.0), ("two", 2.0), ("none", None), ("ties", 7.0), ("ties", 7.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    aggs = [Agg("p50", "v", "a"), Agg("p99", "v", "b"), Agg("percentile", "v", "c", 0.25), Agg("percentile", "v", "lo", 0.0), Agg("percentile", "v", "hi", 1.0), Agg("count", "v", "n")]
    want = sorted(map(str, map(rounded, aggregate(df, aggs, keys).collect())))
    spark.conf.set("spark.tidemark.percentileBytes", "-1")
    try:
        assert sorted(map(str, map(rounded, aggregate(df, aggs, keys).collect()))) == want
    finally:
        spark.conf.unset("spark.tidemark.percentileBytes")
    for accuracy in (5, 60):  # coarse sketches give wide brackets, never other results
        got = exact_percentiles(df, F.col("v"), {"a": 0.5, "b": 0.99}, keys, accuracy)
        exact = aggregate(df.where("v is not null"), aggs[:2], keys)
        assert sorted(map(str, map(rounded, got.collect()))) == sorted(map(str, map(rounded, exact.collect())))
