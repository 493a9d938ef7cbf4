"""Queries over the driver's tables, one or more for every operator, with equivalent SQL for DuckDB.

Keys begin with the operator's id in the inventory. Floating sums are rounded, as their order is free.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as ops
from .functions.aggregates import Agg, aggregate
from .functions.percentiles import exact_percentiles
from .functions.udf import FunctionRegistry, aggregate_by, rows_from
from .operators import stable
from .plans.builder import Builder, Source
from .plans.parser import parse
from .plans.promql import PromQL
from .sources import line_protocol
from .shipping import shared_dir
from .sources.engine import Engine
from .sources.federation import Federation

TIME = {"events": ("ts", ("event_id",)), "lineitem": ("l_shipdate", ("l_orderkey", "l_linenumber")), "orders": ("o_orderdate", ("o_orderkey",))}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shrink(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded; no -0.0."""
    return df.select(*[(F.round(F.col(f"`{c}`"), places) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def select(spark: SparkSession, sf_dir: str, text: str, functions: FunctionRegistry | None = None) -> DataFrame:
    def resolve(name: str) -> Source:
        if name not in TABLES:
            raise ValueError(f"no table {name}")
        ts, tie = TIME.get(name, (None, ()))
        return Source(load(spark, sf_dir, name), ts, tie)

    return Builder(resolve, functions).build(parse(text))


def add(name: str, make, sql: str | None = None) -> None:
    """make: a query text or a function of (spark, sf_dir)."""
    _queries[name] = (lambda spark, d, t=make: shrink(select(spark, d, t))) if isinstance(make, str) else (lambda spark, d, f=make: shrink(f(spark, d)))
    if sql:
        _sql[name] = sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _bucket(ts: str, us: int) -> str:
    return f"make_timestamp((epoch_us({ts}) // {us}) * {us})"


HOUR, DAY = 3_600_000_000, 86_400_000_000

# --- projections and filters ---
add("s1_scan_star", "SELECT * FROM nation", "SELECT * FROM nation")
add("p1_project_alias", "SELECT l_orderkey AS k, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 49", "SELECT l_orderkey AS k, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 49")
add("p3_row_arithmetic", "SELECT event_id, value * 2 + 1 AS a, -value AS b, (value - 3) / 4 AS c, value % 7 AS d, user_id * 2 AS e FROM events",
    "SELECT event_id, round(value * 2 + 1, 6) AS a, round(-value, 6) AS b, round((value - 3) / 4, 6) AS c, round(value % 7, 6) AS d, (user_id * 2)::DOUBLE AS e FROM events")
add("p3a_zero_division", "SELECT event_id, value / (user_id % 2) AS q, value % (user_id % 2) AS r FROM events",
    "SELECT event_id, CASE WHEN user_id % 2 <> 0 THEN round(value / (user_id % 2), 6) END AS q, CASE WHEN user_id % 2 <> 0 THEN round(value % 1.0::DOUBLE, 6) END AS r FROM events")
add("p4_derived_names", "SELECT event_type, count(*), max(user_id) FROM events GROUP BY event_type",
    'SELECT event_type, count(*) AS "count(*)", max(user_id) AS "max(user_id)" FROM events GROUP BY event_type')
add("f1_comparisons", "SELECT event_id FROM events WHERE value > 100 AND value <= 200 AND user_id != 7 AND ts >= '2024-01-05' AND ts < '2024-01-20 12:00:00'",
    "SELECT event_id FROM events WHERE value > 100 AND value <= 200 AND user_id <> 7 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20 12:00:00'")
add("f2_and_or_not", "SELECT event_id FROM events WHERE (value > 150 OR user_id = 3) AND NOT event_type = 'click'", "SELECT event_id FROM events WHERE (value > 150 OR user_id = 3) AND NOT event_type = 'click'")
add("f3_in", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_custkey NOT IN (1, 2, 3)", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_custkey NOT IN (1, 2, 3)")
add("f4_between", "SELECT event_id FROM events WHERE value BETWEEN 10 AND 20 AND user_id NOT BETWEEN 5 AND 50", "SELECT event_id FROM events WHERE value BETWEEN 10 AND 20 AND user_id NOT BETWEEN 5 AND 50")
add("f5_symbol", "SELECT c_custkey FROM customer WHERE c_mktsegment != 'BUILDING' AND c_name != 'nobody'", "SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_name <> 'nobody'")
add("f6_coercion", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber > 1.9 AND l_quantity < 3", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber > 1.9 AND l_quantity < 3")
add("f7_constant", "SELECT count(*) AS n FROM events WHERE 1 AND NOT 0", "SELECT count(*) AS n FROM events")
add("f8_nan", lambda s, d: load(s, d, "events").select("event_id", F.when(F.col("user_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("v")).where(~F.isnan("v") & (F.col("v") > 50)),
    "SELECT event_id, round(value, 6) AS v FROM events WHERE user_id % 3 <> 0 AND value > 50")

# --- aggregates ---
add("a1_a5_basic", "SELECT count(*) AS n, count(value) AS nv, sum(user_id) AS s, sum(value) AS sv, avg(value) AS a, min(value) AS lo, max(ts) AS hi, spread(value) AS sp FROM events",
    "SELECT count(*) AS n, count(value) AS nv, sum(user_id)::BIGINT AS s, round(sum(value), 6) AS sv, round(avg(value), 6) AS a, round(min(value), 6) AS lo, max(ts) AS hi, round(max(value) - min(value), 6) AS sp FROM events")
add("a6_a7_percentiles", "SELECT event_type, p50(value) AS p50, p90(value) AS p90, p99(value) AS p99, percentile(value, 0.25) AS p25, percentile(value, 7) AS top FROM events GROUP BY event_type",
    "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99, round(quantile_cont(value, 0.25), 6) AS p25, round(max(value), 6) AS top FROM events GROUP BY 1")
add("a8_stddev", "SELECT l_returnflag, stddev(l_extendedprice) AS sd FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(stddev_pop(l_extendedprice), 6) AS sd FROM lineitem GROUP BY 1")
add("a9_a10_first_last", "SELECT l_returnflag, first(l_orderkey) AS f, last(l_orderkey) AS l, last_row(l_linestatus) AS r FROM lineitem GROUP BY l_returnflag",
    """SELECT l_returnflag, arg_min(l_orderkey, (l_shipdate, l_orderkey, l_linenumber)) AS f, arg_max(l_orderkey, (l_shipdate, l_orderkey, l_linenumber)) AS l,
    arg_max(l_linestatus, (l_shipdate, l_orderkey, l_linenumber)) AS r FROM lineitem GROUP BY 1""")  # fmt: skip
_TWA = """WITH g AS (SELECT {k} value, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER ({p} ORDER BY ts, event_id) AS d FROM events)
SELECT {k} round(CASE WHEN max(ts) = min(ts) THEN arg_max(value, ts) ELSE sum(value * coalesce(d, 0)) / (epoch_us(max(ts)) - epoch_us(min(ts))) END, 6) AS w FROM g {g}"""
add("a11_twa", "SELECT twa(value) AS w FROM events", _TWA.format(k="", p="", g=""))
add("a11_twa_keyed", "SELECT user_id, twa(value) AS w FROM events GROUP BY user_id", _TWA.format(k="user_id,", p="PARTITION BY user_id", g="GROUP BY user_id"))


def _doubled(x: pd.Series) -> pd.Series:
    return x * 2.0


def _mixed(x: pd.Series, y: pd.Series) -> pd.Series:
    return x + 10.0 * y


def _registry(spark: SparkSession) -> FunctionRegistry:
    r = FunctionRegistry(spark)
    r.create("doubled", ["FLOAT64"], "FLOAT64", _doubled)
    r.create("mixed", ["FLOAT64", "INT64"], "FLOAT64", _mixed)
    return r


add("a12_u4_aggregate_of_udf", lambda s, d: select(s, d, "SELECT event_type, sum(mixed(value, user_id)) AS s FROM events GROUP BY event_type", _registry(s)), "SELECT event_type, round(sum(value + 10 * user_id), 6) AS s FROM events GROUP BY 1")
add("u1_u3_scalar_udf", lambda s, d: select(s, d, "SELECT event_id, doubled(value) AS v FROM events WHERE user_id < 20", _registry(s)), "SELECT event_id, round(value * 2, 6) AS v FROM events WHERE user_id < 20")
add("u1_u3_scalar_udf_whole_table", lambda s, d: select(s, d, "SELECT event_id, doubled(value) AS v FROM events", _registry(s)), "SELECT event_id, round(value * 2, 6) AS v FROM events")
add("a14_distinct_counts", lambda s, d: aggregate(load(s, d, "events"), [Agg("count_distinct", "user_id", "users"), Agg("count", None, "n")], ["event_type"]), "SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY 1")
add("a14_cube", lambda s, d: load(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q")),
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 6) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
add("a22_group_by_two_keys", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q, avg(l_discount) AS d FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 6) AS q, round(avg(l_discount), 6) AS d FROM lineitem GROUP BY 1, 2")
add("a25_group_by_no_aggregate", "SELECT o_orderstatus, o_orderpriority FROM orders GROUP BY o_orderstatus, o_orderpriority", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
add("a26_distinct", "SELECT DISTINCT event_type, user_id FROM events", "SELECT DISTINCT event_type, user_id FROM events")
add("a27_having", "SELECT user_id, count(*) AS n, sum(value) AS total FROM events GROUP BY user_id HAVING n >= 5 AND sum(value) / count(*) > 40 AND NOT user_id IN (1, 2)",
    "SELECT user_id, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1 HAVING count(*) >= 5 AND sum(value) / count(*) > 40 AND user_id NOT IN (1, 2)")
add("a28_merge_partials", lambda s, d: stable.merge_partials(
        load(s, d, "events").groupBy("event_type", (F.col("user_id") % 4).alias("child")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("sv"), F.min("value").alias("lo"), F.max("value").alias("hi")),
        ["event_type"], counts=["n"], sums=["sv"], mins=["lo"], maxs=["hi"], avgs=[("a", "sv", "n")]),
    "SELECT event_type, count(*) AS n, round(sum(value), 6) AS sv, round(min(value), 6) AS lo, round(max(value), 6) AS hi, round(avg(value), 6) AS a FROM events GROUP BY 1")
add("p5_expression_aggregates", "SELECT l_returnflag, sum(l_extendedprice * (1 - l_discount)) AS revenue, sum(l_quantity) / count(*) AS mean FROM lineitem WHERE l_shipdate < '1998-09-02' GROUP BY l_returnflag",
    "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 6) AS revenue, round(sum(l_quantity) / count(*), 6) AS mean FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-09-02' GROUP BY 1")

# --- time windows ---
add("w1_sample_by", "SELECT time_bucket(ts, 1h) AS b, count(*) AS n, avg(value) AS a, sum(value) AS s FROM events SAMPLE BY 1h",
    f"SELECT {_bucket('ts', HOUR)} AS b, count(*) AS n, round(avg(value), 6) AS a, round(sum(value), 6) AS s FROM events GROUP BY 1")
add("w1_sample_by_where", "SELECT time_bucket(ts, 1h) AS b, avg(value) AS a, count(*) AS n FROM events WHERE event_type = 'purchase' SAMPLE BY 1h",
    f"SELECT {_bucket('ts', HOUR)} AS b, round(avg(value), 6) AS a, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1")
add("w1_sample_by_compound", "SELECT count(*) AS n FROM events SAMPLE BY 2h30m WHERE value > 20", f"SELECT {_bucket('ts', 9_000_000_000)} AS window_start, count(*) AS n FROM events WHERE value > 20 GROUP BY 1")
add("w1_sample_by_keyed", "SELECT event_type, time_bucket(ts, 1d) AS b, spread(value) AS sp, last(value) AS l FROM events PARTITION BY event_type SAMPLE BY 1d",
    f"SELECT event_type, {_bucket('ts', DAY)} AS b, round(max(value) - min(value), 6) AS sp, round(arg_max(value, (ts, event_id)), 6) AS l FROM events GROUP BY 1, 2")
add("w2_group_by_time_bucket", "SELECT time_bucket(ts, 6h) AS b, user_id, count(*) AS n FROM events GROUP BY time_bucket(ts, 6h), user_id", f"SELECT {_bucket('ts', 6 * HOUR)} AS b, user_id, count(*) AS n FROM events GROUP BY 1, 2")
add("w3_time_bucket_projection", "SELECT event_id, time_bucket(ts, 15m) AS b FROM events", f"SELECT event_id, {_bucket('ts', 900_000_000)} AS b FROM events")
add("w4_all_aggregates_in_windows", "SELECT time_bucket(ts, 1d) AS b, stddev(value) AS sd, p50(value) AS m, first(value) AS f, last(value) AS l FROM events SAMPLE BY 1d",
    f"SELECT {_bucket('ts', DAY)} AS b, round(stddev_pop(value), 6) AS sd, round(quantile_cont(value, 0.5), 6) AS m, round(arg_min(value, (ts, event_id)), 6) AS f, round(arg_max(value, (ts, event_id)), 6) AS l FROM events GROUP BY 1")
_SESSION = """WITH a AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER ({p} ORDER BY ts, event_id) > {g} THEN 1 ELSE 0 END AS brk FROM events),
b AS (SELECT *, sum(brk) OVER ({p} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM a)
SELECT {k} min(ts) AS window_start, count(*) AS n, round(avg(value), 6) AS a FROM b GROUP BY {k} grp"""
add("w5_session", "SELECT count(*) AS n, avg(value) AS a FROM events SESSION(ts, 5m)", _SESSION.format(p="", k="", g=300_000_000))
add("w5_session_keyed", "SELECT count(*) AS n, avg(value) AS a FROM events PARTITION BY user_id SESSION(ts, 12h)", _SESSION.format(p="PARTITION BY user_id", k="user_id,", g=12 * HOUR))
_STATE = """WITH a AS (SELECT *, CASE WHEN event_type <> lag(event_type) OVER ({p} ORDER BY ts, event_id) THEN 1 ELSE 0 END AS brk FROM events),
b AS (SELECT *, sum(brk) OVER ({p} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM a)
SELECT {k} min(ts) AS window_start, min(event_type) AS event_type, count(*) AS n, round(sum(value), 6) AS s FROM b GROUP BY {k} grp"""
add("w6_state_window", "SELECT event_type, count(*) AS n, sum(value) AS s FROM events STATE_WINDOW(event_type)", _STATE.format(p="", k=""))
add("w6_state_window_keyed", "SELECT event_type, count(*) AS n, sum(value) AS s FROM events PARTITION BY user_id STATE_WINDOW(event_type)", _STATE.format(p="PARTITION BY user_id", k="user_id,"))
_EVENT = """WITH a AS (SELECT *, coalesce(sum(CASE WHEN value < 20 THEN 1 ELSE 0 END) OVER ({p} ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM events),
b AS (SELECT *, min(CASE WHEN value > 150 THEN ts END) OVER (PARTITION BY {k} seg) AS s FROM a)
SELECT {k} min(ts) AS window_start, count(*) AS n, round(avg(value), 6) AS a FROM b WHERE ts >= s GROUP BY {k} seg"""
add("w7_event_window", "SELECT count(*) AS n, avg(value) AS a FROM events EVENT_WINDOW(value > 150, value < 20)", _EVENT.format(p="", k=""))
add("w7_event_window_keyed", "SELECT count(*) AS n, avg(value) AS a FROM events PARTITION BY user_id EVENT_WINDOW(value > 150, value < 20)", _EVENT.format(p="PARTITION BY user_id", k="user_id,"))
_GRID = f"""WITH b AS (SELECT {_bucket('ts', HOUR)} AS b, avg(value) AS a FROM events WHERE event_type = 'purchase' GROUP BY 1),
g AS (SELECT unnest(generate_series(min(b), max(b), INTERVAL 1 HOUR)) AS b FROM b), j AS (SELECT g.b, b.a FROM g LEFT JOIN b USING (b))"""
_FILL = "SELECT time_bucket(ts, 1h) AS b, avg(value) AS a FROM events WHERE event_type = 'purchase' SAMPLE BY 1h FILL({})"
add("w8_fill_prev", _FILL.format("PREV"), f"{_GRID} SELECT b, round(last_value(a IGNORE NULLS) OVER (ORDER BY b), 6) AS a FROM j")
add("w8_fill_null", _FILL.format("NULL"), f"{_GRID} SELECT b, round(a, 6) AS a FROM j")
add("w8_fill_const", _FILL.format("-1.5"), f"{_GRID} SELECT b, round(coalesce(a, -1.5), 6) AS a FROM j")
_NEAR = """, n AS (SELECT b, a, last_value(a IGNORE NULLS) OVER (ORDER BY b) AS pv, last_value(CASE WHEN a IS NOT NULL THEN b END IGNORE NULLS) OVER (ORDER BY b) AS pb,
first_value(a IGNORE NULLS) OVER (ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv, first_value(CASE WHEN a IS NOT NULL THEN b END IGNORE NULLS) OVER (ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nb FROM j)"""
add("w8_fill_linear", _FILL.format("LINEAR"), f"{_GRID}{_NEAR} SELECT b, round(CASE WHEN a IS NOT NULL THEN a ELSE pv + (nv - pv) * (epoch_us(b) - epoch_us(pb)) / (epoch_us(nb) - epoch_us(pb))::DOUBLE END, 6) AS a FROM n")
add("w10_limit_windows", "SELECT time_bucket(ts, 1h) AS b, count(*) AS n FROM events SAMPLE BY 1h ORDER BY b LIMIT 7", f"SELECT {_bucket('ts', HOUR)} AS b, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 LIMIT 7")
add("w11_sliding", lambda s, d: ops.sliding(load(s, d, "events"), "ts", "2h", "1h", [Agg("count", None, "n")]).select("window_start", "n"),
    f"SELECT window_start, count(*) AS n FROM (SELECT {_bucket('ts', HOUR)} - INTERVAL (h) HOUR AS window_start FROM events, (SELECT unnest([0, 1]) AS h)) GROUP BY 1")

# --- row functions ---
_W = "OVER (ORDER BY ts, event_id)"
add("r1_r5_row_functions", "SELECT event_id, diff(value) AS d, derivative(value, 'quotient') AS dv, csum(value) AS c, mavg(value, 5) AS m, lag(value, 3) AS l FROM events",
    f"""SELECT event_id, round(value - lag(value) {_W}, 6) AS d, round((value - lag(value) {_W}) / ((epoch_us(ts) - lag(epoch_us(ts)) {_W}) / 1e6), 6) AS dv,
    round(sum(value) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS c, round(avg(value) OVER (ORDER BY ts, event_id ROWS 4 PRECEDING), 6) AS m, round(lag(value, 3) {_W}, 6) AS l FROM events""")  # fmt: skip
_WU = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"
add("r1_r5_row_functions_keyed", "SELECT event_id, diff(value) AS d, csum(value) AS c, mavg(value, 3) AS m, lag(value) AS l, diff(value) * 2 + 1 AS e FROM events WHERE value > 5 PARTITION BY user_id",
    f"""SELECT event_id, round(value - lag(value) {_WU}, 6) AS d, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS c,
    round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING), 6) AS m, round(lag(value) {_WU}, 6) AS l, round((value - lag(value) {_WU}) * 2 + 1, 6) AS e FROM events WHERE value > 5""")  # fmt: skip
_INTERP = """WITH p AS (SELECT {k} epoch_us(ts) AS t, value AS v FROM events),
b AS (SELECT {k} ((min(t) + {w} - 1) // {w}) * {w} AS lo, (max(t) // {w}) * {w} AS hi, count(*) AS n FROM p {g}),
g AS (SELECT {k} unnest(range(lo, hi + 1, {w})) AS t FROM b WHERE n > 1),
u AS (SELECT {k} t, v, 0 AS f FROM p UNION ALL SELECT {k} t, NULL, 1 FROM g),
n AS (SELECT {k} t, f, last_value(v IGNORE NULLS) OVER w1 AS pv, last_value(CASE WHEN f = 0 THEN t END IGNORE NULLS) OVER w1 AS pt,
  first_value(v IGNORE NULLS) OVER w2 AS nv, first_value(CASE WHEN f = 0 THEN t END IGNORE NULLS) OVER w2 AS nt
  FROM u WINDOW w1 AS ({p} ORDER BY t, f ROWS UNBOUNDED PRECEDING), w2 AS ({p} ORDER BY t, f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT {k} make_timestamp(t) AS ts, round(CASE WHEN pt = t THEN pv ELSE pv + (nv - pv) * ((t - pt) / (nt - pt)::DOUBLE) END, 6) AS v FROM n WHERE f = 1"""
add("r6_interp", "SELECT ts, interp(value, 1h) AS v FROM events", _INTERP.format(k="", g="", p="", w=HOUR))
add("r6_interp_keyed", "SELECT user_id, ts, interp(value, 1d) AS v FROM events PARTITION BY user_id", _INTERP.format(k="user_id,", g="GROUP BY user_id", p="PARTITION BY user_id", w=DAY))
add("r7_sql_windows", lambda s, d: load(s, d, "orders").selectExpr("o_orderkey", "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn", "lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nx"),
    "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INTEGER AS rn, round(lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 6) AS nx FROM orders")

# --- last points, order, joins ---
add("l1_latest_on", "SELECT event_id, user_id, value FROM events WHERE event_type != 'view' LATEST ON ts PARTITION BY user_id",
    "SELECT event_id, user_id, round(value, 6) AS value FROM events WHERE event_type <> 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
add("l1_latest_on_whole_table", "SELECT event_id, user_id FROM events LATEST ON ts", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
add("l3_latest_ties", "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem LATEST ON l_shipdate PARTITION BY l_suppkey",
    "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) = 1")
add("o1_order_by", "SELECT n_name, n_nationkey FROM nation ORDER BY n_name DESC", "SELECT n_name, n_nationkey FROM nation ORDER BY n_name DESC")
add("o3_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", "SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders ORDER BY orders.o_totalprice DESC, o_orderkey LIMIT 25")
add("o4_offset", "SELECT event_id FROM events ORDER BY event_id LIMIT 10 OFFSET 20", "SELECT event_id FROM events ORDER BY event_id LIMIT 10 OFFSET 20")
add("o5_union", lambda s, d: stable.federated([load(s, d, "events").where("event_type = 'click'").select("event_id"), load(s, d, "events").where("value > 100").select("event_id")]),
    "SELECT event_id FROM events WHERE event_type = 'click' UNION ALL SELECT event_id FROM events WHERE value > 100")
add("o6_set_operators", lambda s, d: load(s, d, "orders").select("o_custkey").intersect(load(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"))).exceptAll(load(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("o_custkey"))),
    "SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer EXCEPT SELECT n_nationkey FROM nation")


def _sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = load(s, d, "events")
    return e.where("event_type = 'purchase'").select("event_id", "ts", "user_id", "value"), e.where("event_type <> 'purchase'").select("event_id", "ts", "user_id", "event_type", "value")


_ASOF = """SELECT l.event_id, l.user_id, r.event_id AS r_event_id, r.event_type, round(r.value, 6) AS r_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type <> 'purchase') r ON {on} l.ts >= r.ts"""
_COLS = ("event_id", "user_id", "r_event_id", "event_type", "r_value")
add("j1_asof_keyed", lambda s, d: ops.asof_join(*_sides(s, d), "ts", "ts", ["user_id"], ["event_id"]).select(*_COLS), _ASOF.format(on="l.user_id = r.user_id AND"))
add("j1_asof_hot_key_blocks", lambda s, d: ops.asof_join(*_sides(s, d), "ts", "ts", ["user_id"], ["event_id"], blocks=5).select(*_COLS), _ASOF.format(on="l.user_id = r.user_id AND"))
add("j1_asof_no_key", lambda s, d: ops.asof_join(*_sides(s, d), "ts", "ts", (), ["event_id"]).select(*_COLS), _ASOF.format(on=""))
add("j1c_asof_ties", "SELECT l_orderkey, l_linenumber, o_orderkey FROM lineitem ASOF JOIN orders WHERE l_quantity > 45",
    """WITH o AS (SELECT o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1)
    SELECT l_orderkey, l_linenumber, o_orderkey FROM (SELECT * FROM lineitem WHERE l_quantity > 45) l ASOF LEFT JOIN o ON l.l_shipdate >= o.o_orderdate""")  # fmt: skip
add("j1c_asof_ties_whole_table", "SELECT l_orderkey, l_linenumber, o_orderkey FROM lineitem ASOF JOIN orders",
    """WITH o AS (SELECT o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1)
    SELECT l_orderkey, l_linenumber, o_orderkey FROM lineitem l ASOF LEFT JOIN o ON l.l_shipdate >= o.o_orderdate""")  # fmt: skip
add("j3_joins", lambda s, d: load(s, d, "orders").join(load(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("s")),
    "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 6) AS s FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1")


# --- super-tables: users are children, parity and band of the id are tags ---
def _family(s: SparkSession, d: str, where=None) -> DataFrame:
    e = load(s, d, "events").withColumn("tbname", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    tags = e.select("tbname", (F.col("user_id") % 2).alias("parity"), F.when(F.col("user_id") < 5, "low").otherwise("high").alias("band")).distinct()
    return stable.with_tags(e, tags, where=where)


_TAGGED = "(SELECT *, 'u' || user_id AS tbname, user_id % 2 AS parity, CASE WHEN user_id < 5 THEN 'low' ELSE 'high' END AS band FROM events)"
add("t1_t4_super_table", lambda s, d: aggregate(_family(s, d), [Agg("count", None, "n"), Agg("avg", "value", "a"), Agg("spread", "value", "sp")], ["band"]),
    f"SELECT band, count(*) AS n, round(avg(value), 6) AS a, round(max(value) - min(value), 6) AS sp FROM {_TAGGED} GROUP BY 1")
add("t2_tag_filter", lambda s, d: aggregate(_family(s, d, F.col("parity") == 1), [Agg("count", None, "n"), Agg("sum", "value", "s")]), f"SELECT count(*) AS n, round(sum(value), 6) AS s FROM {_TAGGED} WHERE parity = 1")
add("t3_mixed_filter", lambda s, d: aggregate(_family(s, d).where("band = 'low' AND (parity = 0 OR value > 100)"), [Agg("count", None, "n")]), f"SELECT count(*) AS n FROM {_TAGGED} WHERE band = 'low' AND (parity = 0 OR value > 100)")
add("t5_non_mergeable", lambda s, d: aggregate(_family(s, d), [Agg("p90", "value", "p"), Agg("stddev", "value", "sd")], ["parity"]), f"SELECT parity, round(quantile_cont(value, 0.9), 6) AS p, round(stddev_pop(value), 6) AS sd FROM {_TAGGED} GROUP BY 1")
add("t6_partition_by_tbname", lambda s, d: stable.by_child(_family(s, d), [Agg("count", None, "n"), Agg("last", "value", "l")], "ts"), f"SELECT tbname, count(*) AS n, round(arg_max(value, ts), 6) AS l FROM {_TAGGED} GROUP BY 1")
add("t7_sample_by_over_family", lambda s, d: ops.sample_by(_family(s, d), "ts", "1d", [Agg("count", None, "n")], ["band"], bucket="b"), f"SELECT band, {_bucket('ts', DAY)} AS b, count(*) AS n FROM {_TAGGED} GROUP BY 1, 2")
add("t8_select_tags", lambda s, d: _family(s, d, F.col("band") == "high").select("event_id", "tbname", "parity"), f"SELECT event_id, tbname, parity FROM {_TAGGED} WHERE band = 'high'")

# --- metric expressions ---
def _prom(text: str, matrix: bool = False):
    def run(s: SparkSession, d: str) -> DataFrame:
        e = load(s, d, "events").withColumn("host", F.col("user_id").cast("string"))
        p = PromQL(lambda _: (e.select("ts", "event_type", "host", "value"), "ts"))
        return p.matrix(text) if matrix else p.query(text)

    return run


add("q1_selector", _prom('m{event_type="click",host!="3"}'), "SELECT ts, event_type, user_id::VARCHAR AS host, round(value, 6) AS value FROM events WHERE event_type = 'click' AND user_id <> 3")
_RATE = """(SELECT * FROM (SELECT ts, event_type, user_id::VARCHAR AS host, (value - lag(value) OVER w) / ((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6) AS value
FROM events WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts)) WHERE value IS NOT NULL)"""
add("q2_rate", _prom("rate(m[5m])"), f"SELECT ts, event_type, host, round(value, 6) AS value FROM {_RATE}")
add("q3_avg_over_time", _prom('avg_over_time(m{event_type=~"cl.*|view"}[1d])'), f"SELECT {_bucket('ts', DAY)} AS ts, event_type, user_id::VARCHAR AS host, round(avg(value), 6) AS value FROM events WHERE event_type LIKE 'cl%' OR event_type = 'view' GROUP BY 1, 2, 3")
add("q4_aggregate_by", _prom("sum by (event_type) (m)"), "SELECT event_type, round(sum(value), 6) AS value FROM events GROUP BY 1")
add("q5_nested_aggregate", _prom("max(avg_over_time(m[1d])) by (event_type)"), f"SELECT ts, event_type, round(max(value), 6) AS value FROM (SELECT {_bucket('ts', DAY)} AS ts, event_type, user_id, avg(value) AS value FROM events GROUP BY 1, 2, 3) GROUP BY 1, 2")
add("q7_matrix", lambda s, d: _prom("count_over_time(m[1d])", True)(s, d).select("metric", F.size(F.from_json("values", "array<array<string>>")).alias("points")),
    f"""SELECT '{{"event_type":"' || event_type || '","host":"' || user_id || '"}}' AS metric, count(DISTINCT {_bucket('ts', DAY)})::INTEGER AS points FROM events GROUP BY event_type, user_id""")
add("g2_g3_merged_partials", lambda s, d: aggregate(stable.federated([load(s, d, "events").where(F.col("user_id") % 3 == i) for i in range(3)]), [Agg("avg", "value", "a"), Agg("count", None, "n")], ["event_type"]),
    "SELECT event_type, round(avg(value), 6) AS a, count(*) AS n FROM events GROUP BY 1")
add("q7_matrix_values", lambda s, d: _prom("count_over_time(m[1d])", True)(s, d).select("metric", F.explode(F.from_json("values", "array<array<string>>")).alias("p")).select("metric", F.col("p")[0].cast("double").alias("t"), F.col("p")[1].cast("double").alias("v")),
    f"""SELECT '{{"event_type":"' || event_type || '","host":"' || user_id || '"}}' AS metric, epoch_us({_bucket('ts', DAY)}) / 1e6 AS t, count(*)::DOUBLE AS v FROM events GROUP BY event_type, user_id, {_bucket('ts', DAY)}""")


add("q6_without", _prom("sum without (host) (m)"), "SELECT event_type, round(sum(value), 6) AS value FROM events GROUP BY 1")
add("q6_offset_and_arithmetic", _prom('2 * m{event_type="view"} offset 1h + 1'), "SELECT ts + INTERVAL 1 HOUR AS ts, event_type, user_id::VARCHAR AS host, round(2 * value + 1, 6) AS value FROM events WHERE event_type = 'view'")
# --- sources and sinks ---
def scratch(spark: SparkSession) -> str:
    """A new folder where all executors can write."""
    return f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex[:12]}"


def _line_protocol(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "events")
    lines = e.select(F.concat(F.lit("m\\,x,kind="), F.col("event_type"), F.lit(",u\\ id="), F.col("user_id").cast("string"), F.lit(" id="), F.col("event_id").cast("string"), F.lit('i,v='), F.col("value").cast("string"), F.lit(',ok=t,note="a, b\\"c" '), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string")).alias("value"))
    return line_protocol.measurement(line_protocol.parse(lines), "m,x", ["kind", "u id"], {"id": "INT64", "v": "FLOAT64", "ok": "INT64", "note": "SYMBOL"}).withColumnRenamed("u id", "uid")


add("s9_line_protocol", _line_protocol, """SELECT ts, event_type AS kind, user_id::VARCHAR AS uid, event_id AS id, round(value, 6) AS v, 1::BIGINT AS ok, 'a, b"c' AS note FROM events""")


def _engine(s: SparkSession, d: str) -> Engine:
    e = Engine(s, scratch(s))
    e.sql("CREATE TABLE m (ts TIMESTAMP, id INT64, kind SYMBOL, v FLOAT64) TIMESTAMP(ts) WITH (PARTITION='day')")
    e.append("m", load(s, d, "events").select("ts", F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("value").alias("v")))
    return e


add("s6_s7_append_and_read", lambda s, d: _engine(s, d).sql("SELECT kind, count(*) AS n, sum(v) AS v FROM m WHERE ts >= '2024-01-10' AND ts < '2024-01-20 06:00:00' GROUP BY kind"),
    "SELECT event_type AS kind, count(*) AS n, round(sum(value), 6) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20 06:00:00' GROUP BY 1")


def _export(s: SparkSession, d: str) -> DataFrame:
    e, to = _engine(s, d), scratch(s)
    e.sql(f"EXPORT TABLE m TO PARQUET '{to}'")
    return s.read.parquet(to).select("ts", "id", "kind", "v")


add("s13_export_parquet", _export, "SELECT ts, event_id AS id, event_type AS kind, round(value, 6) AS v FROM events")


def _delete(s: SparkSession, d: str) -> DataFrame:
    e = _engine(s, d)
    e.sql("DELETE FROM m WHERE ts < '2024-01-10 12:00:00'")
    return e.sql("SELECT count(*) AS n, min(ts) AS lo FROM m")


add("d10_delete_partitions", _delete, "SELECT count(*) AS n, min(ts) AS lo FROM events WHERE ts >= TIMESTAMP '2024-01-10'")


def _insert(s: SparkSession, d: str) -> DataFrame:
    e = Engine(s, scratch(s))
    e.sql("CREATE STABLE meters (ts TIMESTAMP, current FLOAT64, voltage INT64) TAGS (location SYMBOL, gid INT64)")
    e.sql("CREATE TABLE d1 USING meters TAGS ('east', 42)")
    e.sql("CREATE TABLE d2 USING meters TAGS ('west', 17)")
    e.sql("INSERT INTO d1 VALUES ('2024-01-01 00:00:00', 1.5, 220), ('2024-01-01 00:00:01', 2, 221), ('2024-01-02', 3, 219)")
    e.sql("INSERT INTO d2 (voltage, ts, current) VALUES (230, '2024-01-01', 4.0), (231, '2024-01-03', 5.0)")
    return e.sql("SELECT location, count(*) AS n, sum(current) AS c, max(voltage) AS v FROM meters GROUP BY location")


add("s5_d4_d6_insert_super_table", _insert, "SELECT * FROM (VALUES ('east', 3::BIGINT, 6.5::DOUBLE, 221::BIGINT), ('west', 2::BIGINT, 9.0::DOUBLE, 231::BIGINT)) t(location, n, c, v)")


def _made(s: SparkSession, columns: str, name: str = "m", root: str | None = None) -> Engine:
    e = Engine(s, root or scratch(s))
    e.sql(f"CREATE TABLE {name} ({columns}) TIMESTAMP(ts)")
    return e


def _batch(s: SparkSession, d: str) -> DataFrame:
    e = _made(s, "ts TIMESTAMP, id INT64, name SYMBOL")
    b = e.batch("m")
    for i, r in enumerate(load(s, d, "nation").orderBy("n_nationkey").collect()):  # 25 rows, as a client would add them
        b.row(ts=f"2024-01-01 00:00:{i:02d}", id=r.n_nationkey, name=r.n_name)
    b.commit()
    return e.sql("SELECT ts, id, name FROM m")


add("s6_batch", _batch, "SELECT TIMESTAMP '2024-01-01' + to_seconds((row_number() OVER (ORDER BY n_nationkey) - 1)::INTEGER) AS ts, n_nationkey::BIGINT AS id, n_name AS name FROM nation")


def _arrow(s: SparkSession, d: str) -> DataFrame:
    e = _made(s, "ts TIMESTAMP, id INT64, kind SYMBOL, v FLOAT64")
    e.append_arrow("m", load(s, d, "events").select("ts", F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("value").alias("v")).toArrow())
    return e.sql("SELECT kind, count(*) AS n, sum(v) AS v, max(id) AS id FROM m GROUP BY kind")


add("s7_append_arrow", _arrow, "SELECT event_type AS kind, count(*) AS n, round(sum(value), 6) AS v, max(event_id) AS id FROM events GROUP BY 1")


def _csv(s: SparkSession, d: str) -> DataFrame:
    e, at = _made(s, "ts TIMESTAMP, id INT64, kind SYMBOL, v FLOAT64"), scratch(s)
    load(s, d, "events").select(F.col("ts").cast("string"), "event_id", "event_type", "value").write.csv(at)
    e.load_csv("m", at)
    return e.sql("SELECT ts, id, kind, v FROM m")


add("s12_csv", _csv, "SELECT ts, event_id AS id, event_type AS kind, round(value, 6) AS v FROM events")


def _ingested(s: SparkSession, d: str) -> DataFrame:
    e = Engine(s, scratch(s))
    lines = load(s, d, "events").select(F.concat(F.lit("m,kind="), F.col("event_type"), F.lit(" id="), F.col("event_id").cast("string"), F.lit("i,v="), F.col("value").cast("string"), F.lit(" "), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string")).alias("value"))
    e.ingest_lines(lines.unionByName(s.createDataFrame([("not a line",), ("# comment",)], "value string")))
    return e.sql("SELECT ts, kind, id, v FROM m")


add("s10_ingest_lines", _ingested, "SELECT ts, event_type AS kind, event_id AS id, round(value, 6) AS v FROM events")


def _restored(s: SparkSession, d: str) -> DataFrame:
    e, to = _engine(s, d), scratch(s)
    e.backup(f"{to}/set")
    e.sql("DROP TABLE m")
    return Engine.restore(s, f"{to}/set", f"{to}/new").sql("SELECT ts, id, kind, v FROM m")


add("s16_backup_restore", _restored, "SELECT ts, event_id AS id, event_type AS kind, round(value, 6) AS v FROM events")


def _migrated(s: SparkSession, d: str) -> DataFrame:
    e, other = _engine(s, d), Engine(s, scratch(s))
    e.migrate(other, ["m"])
    e.migrate(other, ["m"], drop=True)  # done over: nothing comes twice
    return other.sql("SELECT kind, count(*) AS n, min(ts) AS lo FROM m GROUP BY kind")


add("s15_migrate", _migrated, "SELECT event_type AS kind, count(*) AS n, min(ts) AS lo FROM events GROUP BY 1")
add("s3_stats_only", lambda s, d: _engine(s, d).stats("m").where("column <> 'v'"),
    """SELECT 'id' AS "column", min(event_id)::VARCHAR AS least, max(event_id)::VARCHAR AS most, count(*) AS rows FROM events
    UNION ALL SELECT 'ts', min(ts)::VARCHAR, max(ts)::VARCHAR, count(*) FROM events""")  # fmt: skip


def _kept(s: SparkSession, d: str) -> DataFrame:
    e = _engine(s, d)
    e.sweep([("other*", "1s"), ("m", "10d")], dt.datetime(2024, 1, 20))
    e.trim_after("m", dt.datetime(2024, 1, 25, 12))
    e.compact("m")
    return e.sql("SELECT count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM m")


add("d15_d16_retention_and_trim", _kept, "SELECT count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-26'")


def _exactly_deleted(s: SparkSession, d: str) -> DataFrame:
    e = _engine(s, d)
    e.delete_exact("m", "ts < '2024-01-10 12:00:00' OR kind = 'view'")
    return e.sql("SELECT kind, count(*) AS n, min(ts) AS lo FROM m GROUP BY kind")


add("d10_delete_exact", _exactly_deleted, "SELECT event_type AS kind, count(*) AS n, min(ts) AS lo FROM events WHERE ts >= TIMESTAMP '2024-01-10 12:00:00' AND event_type <> 'view' GROUP BY 1")


def _out_of_order(s: SparkSession, d: str) -> DataFrame:
    e = _made(s, "ts TIMESTAMP, id INT64, kind SYMBOL, v FLOAT64")
    rows = load(s, d, "events").select("ts", F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("value").alias("v"))
    for part in (2, 0, 1):  # interleaved and late: every day gets three files
        e.append("m", rows.where(F.col("id") % 3 == part).orderBy(F.desc("ts")))
    return e.sql("SELECT kind, count(*) AS n, avg(v) AS a FROM m PARTITION BY kind SESSION(ts, 5m)")


add("m9_out_of_order", _out_of_order, _SESSION.format(p="PARTITION BY event_type", k="event_type,", g=300_000_000).replace("SELECT event_type, min", "SELECT event_type AS kind, min"))


def _ddl(s: SparkSession, d: str) -> DataFrame:
    e = Engine(s, scratch(s), audit=True)
    for text in (
        "CREATE DATABASE plant", "CREATE DATABASE old", "DROP DATABASE old", "USE DATABASE plant", "CREATE GROUP line1", "CREATE DEVICE press IN GROUP line1", "CREATE DEVICE lathe IN GROUP line1", "DROP DEVICE lathe",
        "CREATE STABLE st (ts TIMESTAMP, v FLOAT64) TAGS (site SYMBOL)", "CREATE TABLE c1 USING st TAGS ('a')", "CREATE TABLE t (ts TIMESTAMP, v FLOAT64) TIMESTAMP(ts)", "ALTER TABLE t ADD COLUMN w INT64",
        "CREATE TABLE gone (ts TIMESTAMP, v FLOAT64) TIMESTAMP(ts)", "DROP TABLE gone", "INSERT INTO t VALUES ('2024-01-01', 1, 2)", "TRUNCATE TABLE t",
        "CREATE USER ann IDENTIFIED BY 'long enough'", "GRANT SELECT ON t TO ann",
        "CREATE CONSUMER GROUP g ON t", "JOIN GROUP g AS c1", "JOIN GROUP g AS c2", "COMMIT OFFSET g AS c1 AT 10", "COMMIT OFFSET g AT 4", "LEAVE GROUP g AS c1",
        "CREATE FUNCTION half (FLOAT64) RETURNS FLOAT64 FROM 'tidemark.workload' SYMBOL '_doubled'", "LIST FUNCTIONS", "DROP FUNCTION half",
    ):
        e.sql(text)
    said = [("database", e.sql("LIST DATABASES"), "name"), ("device", e.sql("LIST DEVICES IN GROUP line1"), "name"), ("stable", e.sql("LIST STABLES"), "name"), ("table", e.sql("LIST TABLES"), "name"), ("column", e.sql("DESCRIBE t"), "concat(col_name, ' ', type)"),
            ("tag", e.sql("DESCRIBE c1").where("is_tag"), "concat(col_name, '=', tag_value)"), ("rows", e.sql("SELECT count(*) AS n FROM t"), "cast(n AS string)"), ("user", e.sql("LIST USERS"), "name"),
            ("offset", e.sql("LIST CONSUMERS"), "concat(partition, ' ', member, ' ', committed)"), ("audit", e.audit_log().where("ok AND action = 'CREATE TABLE'"), "action")]
    e.sql("DROP STABLE st")
    said.append(("left", e.sql("LIST TABLES"), "name"))
    out = None
    for kind, df, what in said:
        one = df.selectExpr(f"'{kind}' AS kind", f"{what} AS said")
        out = one if out is None else out.unionByName(one)
    return out


_DDL = [("database", "plant"), ("device", "press"), ("stable", "st"), ("table", "c1"), ("table", "t"), ("column", "ts TIMESTAMP"), ("column", "v FLOAT64"), ("column", "w INT64"), ("tag", "site=a"), ("rows", "0"), ("user", "ann"),
        ("offset", "0 c2 10"), ("offset", "1 c2 4"), ("offset", "2 c2 10"), ("offset", "3 c2 4"), *[("audit", "CREATE TABLE")] * 3, ("left", "t")]
add("d1_d17_catalog", _ddl, f"SELECT * FROM (VALUES {', '.join(map(str, _DDL))}) t(kind, said)")


def _stores(s: SparkSession, d: str) -> Federation:
    """Two stores with a part of the rows each, and one that is lost."""
    f, e = Federation(s), load(s, d, "events").select("ts", F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("value").alias("v"))
    for part in range(2):
        store = _made(s, "ts TIMESTAMP, id INT64, kind SYMBOL, v FLOAT64")
        store.append("m", e.where(F.col("id") % 2 == part))
        f.add("m*", store.root)
    f.add("*", f"{scratch(s)}/lost")
    return f


def _federated(text: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        out, missed = _stores(s, d).sql(text)
        return out.withColumn("missed", F.lit(len(missed)).cast("long"))

    return run


add("g1_g6_federation", _federated("SELECT kind, avg(v) AS a, count(*) AS n FROM m WHERE ts >= '2024-01-05' GROUP BY kind"), "SELECT event_type AS kind, round(avg(value), 6) AS a, count(*) AS n, 1::BIGINT AS missed FROM events WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY 1")
add("g4_federated_sample_by", _federated("SELECT time_bucket(ts, 1d) AS b, avg(v) AS a, count(*) AS n FROM m SAMPLE BY 1d"), f"SELECT {_bucket('ts', DAY)} AS b, round(avg(value), 6) AS a, count(*) AS n, 1::BIGINT AS missed FROM events GROUP BY 1")
add("q8_metrics_on_tables", lambda s, d: _engine(s, d).promql("avg by (kind) (m)", "v"), "SELECT event_type AS kind, round(avg(value), 6) AS value FROM events GROUP BY 1")


# --- user aggregates and table functions ---
def _partial_moments(rows: pd.DataFrame) -> tuple:
    return len(rows), float((rows.value**3).sum())


def _mean_cube(states: pd.DataFrame) -> float:
    return float(states.s.sum() / states.n.sum())


def _steps(user_id: int, value: float):
    for i in range(user_id % 3):
        yield i, value * i


add("u7_user_aggregate", lambda s, d: aggregate_by(load(s, d, "events"), ["event_type"], ["value"], "n long, s double", _partial_moments, "double", _mean_cube, "m").withColumn("m", F.round(F.col("m") / 1e6, 6)),
    "SELECT event_type, round(avg(value ** 3) / 1e6, 6) AS m FROM events GROUP BY 1")
add("u7_user_table_function", lambda s, d: rows_from(load(s, d, "events").select("event_id", "user_id", "value"), ["user_id", "value"], "step int, scaled double", _steps).select("event_id", "step", "scaled"),
    "SELECT event_id, i::INTEGER AS step, round(value * i, 6) AS scaled FROM (SELECT *, unnest(range(user_id % 3)) AS i FROM events)")


# --- clauses together ---
add("f9_precedence", "SELECT event_id FROM events WHERE user_id = 1 OR user_id = 2 AND value > 50 OR NOT event_type = 'view' AND value + 2 * 3 > 100", "SELECT event_id FROM events WHERE user_id = 1 OR user_id = 2 AND value > 50 OR NOT event_type = 'view' AND value + 2 * 3 > 100")
add("f8_nan_in_the_language", lambda s, d: Builder(lambda _: Source(load(s, d, "events").select("event_id", F.when(F.col("user_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("v")), None)).build(parse("SELECT event_id, v FROM x WHERE v > 50 AND v < 1000000")),
    "SELECT event_id, round(value, 6) AS v FROM events WHERE user_id % 3 <> 0 AND value > 50 AND value < 1000000")
add("j1f_asof_limit", "SELECT l_orderkey, l_linenumber, o_orderkey FROM lineitem ASOF JOIN orders ORDER BY l_orderkey, l_linenumber LIMIT 50",
    """WITH o AS (SELECT o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1)
    SELECT l_orderkey, l_linenumber, o_orderkey FROM lineitem l ASOF LEFT JOIN o ON l.l_shipdate >= o.o_orderdate ORDER BY l_orderkey, l_linenumber LIMIT 50""")  # fmt: skip
add("l2_latest_limit", "SELECT user_id, event_id FROM events LATEST ON ts PARTITION BY user_id ORDER BY user_id LIMIT 10", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 ORDER BY user_id LIMIT 10")
add("a6_sketch_percentiles", lambda s, d: _within(s, d), "SELECT event_type, true AS close FROM events GROUP BY 1")


def _within(s: SparkSession, d: str) -> DataFrame:
    """Whether sketches lie between the exact percentiles a hundredth of the ranks away (a sketch names a value, also of few rows)."""
    got = select(s, d, "SELECT event_type, approx_percentile(value, 0.5) AS m, approx_percentile(value, 0.99) AS h, percentile(value, 0.49) AS m0, percentile(value, 0.51) AS m1, percentile(value, 0.98) AS h0, percentile(value, 1) AS h1 FROM events GROUP BY event_type")
    return got.select("event_type", (F.col("m").between(F.col("m0") - 1e-9, F.col("m1") + 1e-9) & F.col("h").between(F.col("h0") - 1e-9, F.col("h1") + 1e-9)).alias("close"))


add("a7_bracketed_percentiles", lambda s, d: exact_percentiles(load(s, d, "events"), F.col("value"), {"p50": 0.5, "p99": 0.99, "p25": 0.25}, ["event_type"], accuracy=100),
    "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99, round(quantile_cont(value, 0.25), 6) AS p25 FROM events GROUP BY 1")


# --- streams, run to their end ---
def _drained(stream: DataFrame, s: SparkSession, mode: str = "append") -> DataFrame:
    to = scratch(s)
    q = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{to}/state").trigger(availableNow=True).start(f"{to}/out")
    q.awaitTermination()
    return s.read.schema(stream.schema).parquet(f"{to}/out")


def _stream(s: SparkSession, d: str) -> DataFrame:
    from .streaming import live

    return live.source(s, f"{d}/events.parque[t]", load(s, d, "events").schema)


def _live_buckets(s: SparkSession, d: str) -> DataFrame:
    from .streaming import live

    out = live.live_buckets(_stream(s, d), "ts", "1d", [Agg("count", None, "n"), Agg("avg", "value", "a")], ["event_type"], "1 hour")
    return _drained(out, s).select("event_type", F.col("window_start").cast("timestamp_ntz").alias("b"), "n", "a")


add("m8_live_buckets", _live_buckets, f"SELECT event_type, {_bucket('ts', DAY)} AS b, count(*) AS n, round(avg(value), 6) AS a FROM events WHERE {_bucket('ts', DAY)} + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2")


def _subscribe(s: SparkSession, d: str) -> DataFrame:
    from .streaming import live

    return _drained(live.subscribe(_stream(s, d), "event_type", "click").select("event_id", "user_id"), s)


add("m1_m2_subscribe", _subscribe, "SELECT event_id, user_id FROM events WHERE event_type = 'click'")


def _live_events(s: SparkSession, d: str) -> DataFrame:
    from .streaming import live

    out = live.event_windows(_stream(s, d), "ts", "value", F.col("value") > 150, F.col("value") < 20, ["user_id"])
    return _drained(out, s)


_DONE = "(SELECT (epoch_us(max(ts)) // 1000) * 1000 FROM events)"  # the last watermark
_LIVE_EVENT = f"""WITH a AS (SELECT *, coalesce(sum(CASE WHEN value < 20 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM events),
b AS (SELECT *, min(CASE WHEN value > 150 THEN ts END) OVER (PARTITION BY user_id, seg) AS s FROM a)
SELECT user_id, min(ts) AS window_start, max(ts) AS window_end, count(*) AS n, round(sum(value), 6) AS total FROM b WHERE ts >= s
GROUP BY user_id, seg HAVING bool_or(value < 20) AND epoch_us(max(ts)) < {_DONE}"""
_NTZ = lambda df: df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})
add("m8_live_event_windows", lambda s, d: _NTZ(_live_events(s, d)), _LIVE_EVENT)


def _live_states(s: SparkSession, d: str) -> DataFrame:
    from .streaming import live

    return _NTZ(_drained(live.state_windows(_stream(s, d), "ts", "value", "event_type", ["user_id"]), s))


add("m8_live_state_windows", _live_states, f"""WITH a AS (SELECT *, CASE WHEN event_type <> lag(event_type) OVER w THEN 1 ELSE 0 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM a),
c AS (SELECT user_id, grp, min(ts) AS window_start, max(ts) AS window_end, count(*) AS n, round(sum(value), 6) AS total, min(event_type) AS state FROM b GROUP BY user_id, grp),
e AS (SELECT *, lead(window_start) OVER (PARTITION BY user_id ORDER BY grp) AS nx FROM c)
SELECT user_id, window_start, window_end, n, total, state FROM e WHERE epoch_us(nx) < {_DONE}""")


def _live_sessions(s: SparkSession, d: str) -> DataFrame:
    from .streaming import live

    return _NTZ(_drained(live.live_sessions(_stream(s, d), "ts", "12h", [Agg("count", None, "n"), Agg("sum", "value", "total")], ["user_id"]), s))


add("m8_live_sessions", _live_sessions, f"""WITH a AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w >= {12 * HOUR} THEN 1 ELSE 0 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM a)
SELECT user_id, min(ts) AS window_start, max(ts) AS window_end, count(*) AS n, round(sum(value), 6) AS total FROM b GROUP BY user_id, grp HAVING epoch_us(max(ts)) + {12 * HOUR} <= {_DONE}""")


def _forwarded(s: SparkSession, d: str) -> DataFrame:
    from .streaming import live

    to = scratch(s)
    f = live.Forwarder(f"{to}/out")
    q = _stream(s, d).select("event_id", "event_type", "value").writeStream.foreachBatch(f).option("checkpointLocation", f"{to}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.parquet(f"{to}/out").drop("batch")


add("s17_forwarder", _forwarded, "SELECT event_id, event_type, round(value, 6) AS value FROM events")


def _delivered(s: SparkSession, d: str) -> DataFrame:
    from .streaming import live

    to = scratch(s)
    q = live.deliver(live.subscribe(_stream(s, d), "event_type", "view").select("event_id"), lambda df, n: df.write.mode("overwrite").parquet(f"{to}/out/batch={n}"), f"{to}/state", every="10 milliseconds")
    live.unsubscribe(q)
    return s.read.parquet(f"{to}/out").drop("batch")


add("m3_m4_coalesced_subscription", _delivered, "SELECT event_id FROM events WHERE event_type = 'view'")
