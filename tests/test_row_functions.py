"""Row functions on long sums and on rows of one instant."""

import datetime as dt
import math
import random

import duckdb
import pytest

import tidemark.operators as ops
import tidemark.workload as w
from oracle import compare
from tidemark.plans.lexer import QueryError

T0 = dt.datetime(2024, 1, 1)


def series(spark, values, per_instant=1):
    rows = [(T0 + dt.timedelta(seconds=i // per_instant), i, "xy"[i % 5 == 0], v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "ts timestamp_ntz, id int, k string, v double").repartition(4)


@pytest.mark.parametrize("keys", [(), ("k",)])
@pytest.mark.parametrize("blocks", [1, 7])
def test_csum_does_not_drift(spark, blocks, keys):
    r = random.Random(3)
    values = [r.choice([None, 1e9, -1e9, 3e8]) if i % 50 == 0 else r.random() for i in range(6000)]
    got = {x.id: x.c for x in ops.csum(series(spark, values, 3), "ts", "v", "c", keys, ["id"], blocks).collect()}
    seen = {}
    for i, v in enumerate(values):
        past = seen.setdefault("xy"[i % 5 == 0] if keys else None, [])
        past += [] if v is None else [v]
        assert got[i] == (math.fsum(past) if past else None), i


@pytest.mark.parametrize("blocks", [1, 3])
def test_csum_of_what_is_not_finite(spark, blocks):
    get = lambda *v: [x.c for x in ops.csum(series(spark, v), "ts", "v", "c", blocks=blocks).orderBy("id").collect()]
    inf = math.inf
    assert get(None, None, 1.0, None, inf, 2.0, None) == [None, None, 1.0, 1.0, inf, inf, inf]
    assert list(map(str, get(1.0, inf, 2.0, -inf, 3.0))) == ["1.0", "inf", "inf", "nan", "nan"]


@pytest.mark.parametrize("blocks", [1, 3])
def test_derivative_as_a_quotient(spark, blocks):
    df = series(spark, [0.0, 5.0, 5.0, 1.0, None, 4.0], 4)
    got = [x.d for x in ops.derivative(df, "ts", "v", "d", tie=["id"], blocks=blocks, quotient=True).orderBy("id").collect()]
    assert list(map(str, got)) == ["None", "inf", "nan", "-inf", "None", "None"]
    got = [x.d for x in ops.derivative(df, "ts", "v", "d", tie=["id"], blocks=blocks).orderBy("id").collect()]
    assert got == [None, 0.0, 0.0, 0.0, None, 0.0]


@pytest.mark.parametrize("blocks", [None, 5])
def test_query_on_copies(spark, sf, tmp_path, blocks):
    """Rows repeated with other keys at the same instants, with values whose sums are long."""
    duckdb.sql(f"""COPY (SELECT event_id + 1000 * k AS event_id, ts, user_id, event_type, round(value * 1000 + CASE k % 3 WHEN 1 THEN 0.01 ELSE 0 END, 2) AS value, props
    FROM '{sf}/events.parquet', (SELECT unnest(range(60)) AS k)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    if blocks:
        spark.conf.set("spark.tidemark.blocks", str(blocks))
    try:
        got = w.queries()["r1_r5_row_functions"](spark, str(tmp_path))
        assert compare(got, tmp_path, w.oracle_sql()["r1_r5_row_functions"], ["events"]) == 60_000
    finally:
        spark.conf.unset("spark.tidemark.blocks")


def test_derivative_takes_one_word(spark, sf):
    with pytest.raises(QueryError):
        w.select(spark, sf, "SELECT derivative(value, 'zero') FROM events")
