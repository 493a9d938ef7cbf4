"""The query language: what it accepts, what it refuses, and rules beyond SQL."""

import datetime as dt

import pytest

from tidemark.plans import ast as a
from tidemark.plans.builder import Builder, Source
from tidemark.plans.lexer import QueryError, interval_nanos, tokens
from tidemark.plans.parser import parse
from tidemark.plans.promql import PromQL, selector
from tidemark.workload import select

T0 = dt.datetime(2026, 1, 1)


@pytest.fixture(scope="module")
def q(spark):
    rows = [(T0 + dt.timedelta(seconds=i), s, float(p), i) for i, (s, p) in enumerate([("AAPL", 10), ("AAPL", 20), ("AAPL", 30), ("MSFT", 5), ("MSFT", 5), ("GOOG", 100)])]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, sym string, price double, vol long")
    return lambda text: Builder(lambda name: Source(df, "ts", ("vol",))).build(parse(text))


def test_lexer():
    assert interval_nanos("2h30m") == 9000 * 10**9 and interval_nanos("500ms") == 5 * 10**8
    assert [t.value for t in tokens("x>=1.5e3 -- c\n AND 'it''s'")][:5] == ["x", ">=", 1500.0, "AND", "it's"]
    with pytest.raises(QueryError):
        tokens("a # b")
    with pytest.raises(QueryError):
        interval_nanos("3w")


def test_precedence():
    e = parse("SELECT x FROM t WHERE a = 1 OR b = 2 AND NOT c = 3 + 4 * 5").where
    assert e.op == "OR" and e.right.op == "AND" and e.right.right == a.Unary("NOT", a.Binary("=", a.Name("c"), a.Binary("+", a.Literal(3), a.Binary("*", a.Literal(4), a.Literal(5)))))


@pytest.mark.parametrize("text", ["", "SELECT", "SELECT FROM t", "SELECT a FROM t WHERE", "SELECT a FROM t x y", "SELECT a FROM t LIMIT 1.5", "SELECT a FROM t WHERE a IN ()", "SELECT a FROM t SAMPLE BY 1h SESSION(ts, 1s)",
                                  "SELECT a FROM t HAVING a > 1", "SELECT a FROM t FILL(PREV)", "SELECT a FROM t SAMPLE BY 1h FILL(CUBIC)", "SELECT DISTINCT a FROM t GROUP BY a", "SELECT a FROM t; SELECT b", "DROP", "INSERT INTO t VALUES",
                                  "SELECT a FROM t WHERE a = 1 WHERE b = 2", "CREATE TABLE t (a WIDE) TIMESTAMP(a)", "COMMIT OFFSET g AS c", "SELECT a b FROM t", "SELECT (a FROM t"])
def test_refused(text):
    with pytest.raises(QueryError):
        parse(text)


@pytest.mark.parametrize("text", ["SELECT nope FROM t", "SELECT sum(sym) FROM t", "SELECT sum(1) FROM t", "SELECT price + sym FROM t", "SELECT nope(price) FROM t", "SELECT price FROM t SAMPLE BY 1h", "SELECT percentile(price) FROM t",
                                  "SELECT price FROM t ORDER BY vol", "SELECT price FROM t WHERE ts > 'yesterday'", "SELECT mavg(price) FROM t", "SELECT price, sym FROM t WHERE sum(price) > 1", "SELECT time_bucket(ts, 0s) FROM t"])
def test_refused_by_schema(q, text):
    with pytest.raises((QueryError, ValueError)):
        q(text)


def one(df, col=0):
    return sorted(r[col] for r in df.collect())


def test_having(q):
    assert one(q("SELECT sym, count(*) FROM t GROUP BY sym HAVING count(*) >= 2")) == ["AAPL", "MSFT"]
    assert one(q("SELECT sym, avg(price) AS a FROM t GROUP BY sym HAVING avg(price) < 10")) == ["MSFT"]
    assert one(q("SELECT sym FROM t GROUP BY sym HAVING sym = 'GOOG'")) == ["GOOG"]
    assert one(q("SELECT sym FROM t GROUP BY sym HAVING sym != 'GOOG' AND sum(vol) > 3")) == ["MSFT"]
    assert one(q("SELECT sym, sum(price) AS total FROM t GROUP BY sym HAVING total > 20")) == ["AAPL", "GOOG"]
    assert one(q("SELECT sym, sum(price) AS total FROM t GROUP BY sym HAVING total BETWEEN 5 AND 60")) == ["AAPL", "MSFT"]


def test_time_literals(q):
    assert q("SELECT vol FROM t WHERE ts >= '2026-01-01 00:00:02' AND ts < '2026-01-01T00:00:04.000000001Z'").count() == 2
    assert q(f"SELECT vol FROM t WHERE ts = {1767225600 * 10**9 + 10**9}").collect()[0][0] == 1
    assert q("SELECT vol FROM t WHERE sym = '2026-01-01'").count() == 0  # text columns keep text


def test_names_and_order(q):
    df = q("SELECT price*2, SYM AS s FROM t ORDER BY s DESC")
    assert df.columns == ["price*2", "s"] and df.first().s == "MSFT"
    assert [r[0] for r in q("SELECT ts, price FROM t ORDER BY ts DESC LIMIT 2").select("price").collect()] == [100.0, 5.0]
    assert q("SELECT sym, count(*) FROM t GROUP BY sym ORDER BY count(*) DESC LIMIT 1").first()[0] == "AAPL"


def test_windows_with_and_without_keys(q):
    assert one(q("SELECT count(*) AS n FROM t SESSION(ts, 1s)"), 1) == [6]
    assert [r.n for r in q("SELECT sym, count(*) AS n FROM t STATE_WINDOW(sym) ORDER BY window_start").collect()] == [3, 2, 1]
    assert [r.n for r in q("SELECT count(*) AS n FROM t WHERE price != 20 EVENT_WINDOW(price > 20, price < 10) ORDER BY window_start").collect()] == [2, 1]
    assert q("SELECT sym, price FROM t WHERE price < 50 LATEST ON ts").first().sym == "MSFT"
    assert one(q("SELECT sym, count(*) AS n FROM t PARTITION BY sym SAMPLE BY 1m"), 2) == [1, 2, 3]


def test_division_by_zero_is_null(q):
    assert [r[0] for r in q("SELECT price / (vol - vol) AS x FROM t").collect()] == [None] * 6


def test_empty_results(q):
    for text in ("SELECT sum(price) AS s, count(*) AS n FROM t WHERE vol > 99", "SELECT twa(price) AS s, count(*) AS n FROM t WHERE vol > 99"):
        assert tuple(q(text).first()) == (None, 0)
    assert q("SELECT count(*) AS n FROM t WHERE vol > 99 SAMPLE BY 1h FILL(PREV)").count() == 0


def test_selectors():
    s = selector('m{a="x\\"y",b!~"c.*"}[5m]')
    assert s.metric == "m" and s.labels == (("a", "=", 'x"y'), ("b", "!~", "c.*")) and s.width == "5m"
    for bad in ("m{", 'm{a=x}', "m{a<'1'}", "1m"):
        with pytest.raises(QueryError):
            selector(bad)


def test_promql_errors(spark, sf):
    p = PromQL(lambda _: (spark.read.parquet(f"{sf}/events.parquet"), "ts"))
    for bad in ("rate(m)", "m[5m]", "nope(m[5m])", "sum by (nope) (m)", 'm{nope="1"}', "sum(m", "sum(m) without (x)"):
        with pytest.raises(QueryError):
            p.query(bad)


def test_unknown_table(spark, sf):
    with pytest.raises(ValueError):
        select(spark, sf, "SELECT a FROM nowhere")


def test_metric_arithmetic_and_offset(spark):
    import datetime as dt

    from tidemark.plans.lexer import QueryError
    from tidemark.plans.promql import PromQL

    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(t, "a", "x", 3.0), (t, "b", "x", 5.0)], "ts timestamp_ntz, host string, zone string, value double")
    p = PromQL(lambda _: (df, "ts"))
    value = lambda text: sorted(r.value for r in p.query(text).collect())
    assert value("2 * m + 1") == [7.0, 11.0] and value("1 + 2 * m") == [7.0, 11.0] and value("2 * (m + 1)") == [8.0, 12.0]
    assert value("10 - m - 1") == [4.0, 6.0] and value('m{host="a"} / 0') == [None] and value("m * -1") == [-5.0, -3.0] and value("1e-3 * m") == [0.003, 0.005]
    assert value("sum without (host) (m) * 2") == [16.0] and value("max(m) without (zone)") == [3.0, 5.0] and value("sum(m) / 2") == [4.0]
    assert {r.ts for r in p.query("m offset 1h").collect()} == {t + dt.timedelta(hours=1)} and {r.ts for r in p.query("m offset -1h").collect()} == {t - dt.timedelta(hours=1)}
    for bad in ("m + m", "1 + 1", "sum without (nolabel) (m)"):
        with pytest.raises(QueryError):
            p.query(bad)
