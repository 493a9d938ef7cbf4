"""Tables, statements, ingest, maintenance, backup."""

import datetime as dt

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.plans.lexer import QueryError
from tidemark.sources import line_protocol
from tidemark.sources.engine import Engine


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "store"))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_insert_select_reopen(engine, spark):
    engine.sql("CREATE TABLE t (ts TIMESTAMP, s SYMBOL, f FLOAT32, i INT64) TIMESTAMP(ts)")
    assert engine.sql("SELECT count(*) AS n FROM t").first().n == 0
    assert engine.sql("INSERT INTO t VALUES ('2024-01-01', 'a', 1.5, -3), ('2024-01-02 10:00:00.5', 'b', 2, 4)").first().n == 2
    engine.sql("INSERT INTO t (i, f, s, ts) VALUES (7, 1, 'it''s', 1704067200000000000)")
    again = Engine(spark, engine.root)
    assert rows(again.sql("SELECT s, i FROM t WHERE ts < '2024-01-02'")) == [("a", -3), ("it's", 7)]
    assert again.sql("SELECT * FROM t").columns == ["ts", "s", "f", "i"]
    for bad in ("INSERT INTO t VALUES ('2024-01-01', 'a', 1.5)", "INSERT INTO t VALUES ('2024-01-01', 1, 1.5, 3)", "INSERT INTO t VALUES ('x', 'a', 1.5, 3)", "INSERT INTO t (ts, s) VALUES ('2024-01-01', 'a')", "INSERT INTO t VALUES ('2024-01-01', 'a', 1, 1.5)",
                "CREATE TABLE t (ts TIMESTAMP) TIMESTAMP(ts)", "CREATE TABLE u (ts INT64) TIMESTAMP(ts)", "DROP TABLE nope", "SELECT a FROM nope"):
        with pytest.raises(QueryError):
            engine.sql(bad)


def test_partition_pruning(engine):
    engine.sql("CREATE TABLE t (ts TIMESTAMP, v FLOAT64) TIMESTAMP(ts) WITH (PARTITION='hour')")
    engine.sql("INSERT INTO t VALUES ('2024-01-01 00:30:00', 1), ('2024-01-01 01:30:00', 2), ('2024-01-02 05:00:00', 3)")
    df = engine.sql("SELECT v FROM t WHERE ts >= '2024-01-01 01:00:00' AND ts < '2024-01-02'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert rows(df) == [(2.0,)] and "PartitionFilters: [isnotnull(_part_hour" in plan
    assert engine.sql("SELECT v FROM t WHERE ts BETWEEN '2024-01-01 00:30:00' AND '2024-01-01 01:30:00'").count() == 2


def test_delete_truncate_alter_describe(engine):
    engine.sql("CREATE TABLE t (ts TIMESTAMP, v FLOAT64) TIMESTAMP(ts)")
    engine.sql("INSERT INTO t VALUES ('2024-01-01 05:00:00', 1), ('2024-01-02 05:00:00', 2), ('2024-01-03 05:00:00', 3)")
    assert engine.sql("DELETE FROM t WHERE ts < '2024-01-02 06:00:00'").first().n == 1  # the border partition stays
    assert rows(engine.sql("SELECT v FROM t")) == [(2.0,), (3.0,)]
    engine.delete_exact("t", "ts < '2024-01-02 06:00:00' OR v > 99")
    assert rows(engine.sql("SELECT v FROM t")) == [(3.0,)]
    engine.sql("ALTER TABLE t ADD COLUMN w INT64")
    assert rows(engine.sql("SELECT v, w FROM t")) == [(3.0, None)]
    assert [(r.col_name, r.type) for r in engine.sql("DESCRIBE TABLE t").collect()] == [("ts", "TIMESTAMP"), ("v", "FLOAT64"), ("w", "INT64")]
    with pytest.raises(QueryError):
        engine.sql("DELETE FROM t WHERE v > 1")
    engine.sql("TRUNCATE TABLE t")
    assert engine.sql("SELECT v FROM t").count() == 0
    engine.sql("DROP TABLE t")
    assert engine.sql("LIST TABLES").count() == 0


def test_super_tables(engine):
    engine.sql("CREATE DATABASE iot")
    engine.sql("USE DATABASE iot")
    engine.sql("CREATE GROUP plant WITH (region='eu', retention=30d, color='red')")
    engine.sql("CREATE DEVICE pump IN GROUP plant WITH (type='pump', floor=3)")
    engine.sql("CREATE STABLE meters (ts TIMESTAMP, current FLOAT32, voltage INT64) TAGS (location SYMBOL, groupId INT64)")
    engine.sql("CREATE TABLE d1 USING meters TAGS ('east', 42)")
    engine.sql("CREATE TABLE d2 USING meters TAGS ('west', 17)")
    assert engine.sql("SELECT count(*) AS n FROM meters").first().n == 0
    engine.sql("INSERT INTO d1 VALUES ('2024-01-01', 1, 220), ('2024-01-02', 2, 221), ('2024-01-03', 3, 222)")
    engine.sql("INSERT INTO d2 VALUES ('2024-01-01', 4, 230), ('2024-01-02', 5, 231)")
    assert engine.sql("SELECT count(*) AS n FROM meters").first().n == 5
    assert engine.sql("SELECT count(*) AS n FROM meters WHERE location = 'east'").first().n == 3
    assert rows(engine.sql("SELECT count(*) AS n, twa(current) AS w FROM meters PARTITION BY tbname")) == [("d1", 3, 2.5), ("d2", 2, 5.0)]
    assert rows(engine.sql("SELECT tbname, groupId, voltage FROM meters WHERE location = 'west' OR voltage > 221")) == [("d1", 42, 222), ("d2", 17, 230), ("d2", 17, 231)]
    assert rows(engine.sql("SELECT location, avg(voltage) AS v FROM meters GROUP BY location")) == [("east", 221.0), ("west", 230.5)]
    assert rows(engine.sql("LIST STABLES")) == [("meters", "iot")] and engine.sql("SHOW DEVICES IN GROUP plant").count() == 1
    assert engine.sql("DESCRIBE d1").where("is_tag").count() == 2
    for bad in ("CREATE TABLE d3 USING meters TAGS ('x')", "CREATE TABLE d3 USING meters TAGS (1, 2)", "ALTER TABLE d1 ADD x INT64"):
        with pytest.raises(QueryError):
            engine.sql(bad)
    engine.sql("DROP STABLE meters")
    assert engine.sql("LIST TABLES").count() == 0


def test_batch_arrow_csv_export(engine, tmp_path, spark):
    engine.sql("CREATE TABLE t (ts TIMESTAMP, s SYMBOL, v FLOAT64) TIMESTAMP(ts)")
    b = engine.batch("t")
    b.row(ts="2024-01-01", s="a", v=1).row(ts=dt.datetime(2024, 1, 2), s="", v=2.0)
    assert b.commit() == 2 and b.commit() == 0
    b.row(ts="2024-01-01", s="z", v=1)
    b.discard()
    engine.append_arrow("t", {"v": pa.array([3.0]), "ts": pa.array([dt.datetime(2024, 1, 3)]), "s": pa.array(["c"])})
    (tmp_path / "x.csv").write_text("2024-01-04 00:00:00,d,4.5\n2024-01-04 01:00:00,e,5.5\n")
    assert engine.sql(f"WRITE TO t FROM FILE '{tmp_path}/x.csv'").first().n == 2
    assert engine.sql(f"EXPORT TABLE t TO PARQUET '{tmp_path}/out'").first().n == 4
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    assert rows(engine.sql("SELECT s, count(*) AS n FROM t GROUP BY s")) == [("", 1), ("a", 1), ("c", 1), ("d", 1), ("e", 1)]


def test_line_protocol(engine, spark):
    lines = ['test a=42i,b=true,c="hello world",d=3.14 1000', "my\\,measurement,tag\\=key=val\\=ue field=1.0 2000", "test,host=h1 a=7u,d=-1e3 5000", "", "# note", "broken", "test a=", "test a=1x 5", 'q t="a,b=c \\"d\\"",u=f 3000', "test a=1i,a=2i 9", "now v=1 0"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    parsed = {r.line: r for r in line_protocol.parse(df).collect()}
    assert [x for x in lines if x in parsed and parsed[x].error] == ["broken", "test a=", "test a=1x 5", "test a=1i,a=2i 9"]
    one = parsed[lines[0]]
    assert one.ts_ns == 1000 and one.fields["a"].i == 42 and one.fields["b"].i == 1 and one.fields["c"].s == "hello world" and one.fields["d"].d == 3.14
    assert parsed[lines[1]].measurement == "my,measurement" and parsed[lines[1]].tags == {"tag=key": "val=ue"}
    assert parsed[lines[8]].fields["t"].s == 'a,b=c "d"'
    assert abs(parsed[lines[10]].ts - dt.datetime.now(dt.UTC).replace(tzinfo=None)) < dt.timedelta(minutes=5)
    counts = engine.ingest_lines(df.where(~F.col("value").contains("my")))
    assert counts == {"test": 2, "q": 1, "now": 1, "": 4}
    assert rows(engine.sql("SELECT a, host FROM test").na.fill("-")) == [(7, "h1"), (42, "-")]
    engine.ingest_lines(spark.createDataFrame([("test,host=h2,new=x a=1i,extra=2 7000",)], "value string"))  # unknown keys are dropped
    assert engine.sql("SELECT a FROM test").count() == 3 and "extra" not in engine.sql("SELECT * FROM test").columns


def test_retention_trim_compact(engine):
    engine.sql("CREATE TABLE cpu_a (ts TIMESTAMP, v FLOAT64) TIMESTAMP(ts)")
    for day in (1, 2, 3, 4):
        engine.sql(f"INSERT INTO cpu_a VALUES ('2024-01-0{day} 10:00:00', {day})")
        engine.sql(f"INSERT INTO cpu_a VALUES ('2024-01-0{day} 09:00:00', {day})")
    assert engine.compact("cpu_a") == 4 and engine.compact("cpu_a") == 0
    assert engine.sweep([("mem*", "1d"), ("cpu*", "2d"), ("*", "1s")], dt.datetime(2024, 1, 4, 12)) == {"cpu_a": 1}
    assert engine.trim_after("cpu_a", dt.datetime(2024, 1, 3, 12)) == 1
    assert rows(engine.sql("SELECT v FROM cpu_a")) == [(2.0,), (2.0,), (3.0,), (3.0,)]


def test_backup(engine, spark, tmp_path):
    engine.sql("CREATE TABLE t (ts TIMESTAMP, v FLOAT64) TIMESTAMP(ts)")
    engine.sql("CREATE TABLE empty (ts TIMESTAMP, v FLOAT64) TIMESTAMP(ts)")
    engine.sql("INSERT INTO t VALUES ('2024-01-01', 1), ('2024-01-05', 2)")
    manifest = engine.backup(str(tmp_path / "set"))
    other = Engine.restore(spark, str(tmp_path / "set"), str(tmp_path / "other"))
    assert other.verify(manifest) == [] and other.sql("SELECT v FROM t").count() == 2
    other.sql("INSERT INTO t VALUES ('2024-01-06', 3)")
    assert other.verify(manifest) == ["t"]
    with pytest.raises(FileNotFoundError):
        Engine.restore(spark, str(tmp_path / "nothing"), str(tmp_path / "x"))


def twice(x):
    return x * 2


def test_functions(engine):
    engine.functions.create("twice", ["FLOAT64"], "FLOAT64", twice)
    engine.sql("CREATE FUNCTION half (FLOAT64) RETURNS FLOAT64 FROM 'tidemark.workload' SYMBOL '_doubled'")
    engine.sql("CREATE TABLE t (ts TIMESTAMP, v FLOAT64) TIMESTAMP(ts)")
    engine.sql("INSERT INTO t VALUES ('2024-01-01', 1), ('2024-01-02', 2)")
    assert rows(engine.sql("SELECT half(v) AS a FROM t")) == [(2.0,), (4.0,)]
    assert engine.sql("SELECT sum(half(v)) AS a FROM t").first().a == 6.0
    assert engine.sql("LIST FUNCTIONS").count() == 2
    engine.sql("DROP FUNCTION half")
    for bad in ("SELECT half(v) FROM t",):
        with pytest.raises(QueryError):
            engine.sql(bad)
    with pytest.raises(ValueError):
        engine.functions.create("sum", ["FLOAT64"], "FLOAT64", twice)
    with pytest.raises(ValueError):
        engine.functions.create("wide", ["FLOAT64", "INT64"], "FLOAT64", twice)


def test_consumer_groups(engine):
    engine.sql("CREATE TABLE t (ts TIMESTAMP, v FLOAT64) TIMESTAMP(ts)")
    engine.sql("CREATE CONSUMER GROUP g ON t")
    engine.sql("JOIN GROUP g AS c1")
    engine.sql("JOIN GROUP g AS c2")
    engine.sql("COMMIT OFFSET g AS c1 AT 10")
    engine.sql("COMMIT OFFSET g AT 4")
    engine.sql("COMMIT OFFSET g AT 2 AS c2")
    assert [(r.member, r.committed) for r in engine.sql("LIST CONSUMERS").orderBy("partition").collect()] == [("c1", 10), ("c2", 4), ("c1", 10), ("c2", 4)]
    engine.sql("LEAVE GROUP g AS c1")
    assert {r.member for r in engine.sql("LIST CONSUMERS").collect()} == {"c2"}
    engine.sql("DROP CONSUMER GROUP g")


def test_promql_on_tables(engine):
    engine.sql("CREATE TABLE cpu (ts TIMESTAMP, host SYMBOL, value FLOAT64) TIMESTAMP(ts)")
    engine.sql("INSERT INTO cpu VALUES ('2024-01-01 00:00:00', 'a', 1), ('2024-01-01 00:00:10', 'a', 6), ('2024-01-01 00:00:00', 'b', 3)")
    assert [tuple(r)[1:] for r in engine.promql('rate(cpu{host="a"}[1m])').collect()] == [("a", 0.5)]
    assert rows(engine.promql("avg by (host) (cpu)")) == [("a", 3.5), ("b", 3.0)]


def test_two_engines_on_one_store(engine, spark):
    """A change that another engine has overtaken is refused, not lost; statements see the newest catalog."""
    other = Engine(spark, engine.root)
    engine.sql("CREATE TABLE a (ts TIMESTAMP, v FLOAT64) TIMESTAMP(ts)")
    other.sql("CREATE TABLE b (ts TIMESTAMP, v FLOAT64) TIMESTAMP(ts)")
    assert {r.name for r in Engine(spark, engine.root).sql("LIST TABLES").collect()} == {"a", "b"}
    engine.refresh()
    other.sql("CREATE CONSUMER GROUP g ON a")
    engine.catalog["tables"]["c"] = {"columns": [["ts", "TIMESTAMP"]], "ts": "ts", "props": {}}
    with pytest.raises(QueryError):
        engine._save()
    assert "g" in engine.catalog["consumers"] and "c" not in engine.catalog["tables"]
    for n in range(8):  # old versions go
        engine.sql(f"COMMIT OFFSET g AT {n}")
    assert len([n for n in engine.files.names(engine.root) if n.startswith("catalog.json.")]) <= 5


def test_broken_rewrites_are_settled(engine):
    engine.sql("CREATE TABLE t (ts TIMESTAMP, v FLOAT64) TIMESTAMP(ts)")
    for day in (1, 2):
        engine.sql(f"INSERT INTO t VALUES ('2024-01-0{day}', {day})")
        engine.sql(f"INSERT INTO t VALUES ('2024-01-0{day} 12:00:00', {day})")
    at = engine.path("t")
    engine.files.rename(f"{at}/_part_day=20240101", f"{at}/_old-_part_day-20240101")  # the work ended here
    assert engine.sql("SELECT v FROM t").count() == 2
    assert engine.recover("t") == 1 and engine.sql("SELECT v FROM t").count() == 4
    engine.delete_exact("t", "v = 1 OR ts = '2024-01-02 12:00:00'")
    assert rows(engine.sql("SELECT v FROM t")) == [(2.0,)] and [n for n in engine.files.names(at) if n.startswith("_old")] == []


def test_statistics_from_footers(engine):
    engine.sql("CREATE TABLE t (ts TIMESTAMP, id INT64, v FLOAT64, s SYMBOL) TIMESTAMP(ts)")
    engine.sql("INSERT INTO t VALUES ('2024-01-01', 4, 1.5, 'a'), ('2024-01-03', -2, 0.5, 'b')")
    df = engine.stats("t")
    assert "PushedAggregation: [COUNT(*), MIN(id)" in df._jdf.queryExecution().toString()
    assert sorted(tuple(r) for r in df.collect()) == [("id", "-2", "4", 2), ("ts", "2024-01-01 00:00:00", "2024-01-03 00:00:00", 2), ("v", "0.5", "1.5", 2)]
    engine.sql("CREATE TABLE none (ts TIMESTAMP, v FLOAT64) TIMESTAMP(ts)")
    assert {tuple(r) for r in engine.stats("none").collect()} == {("ts", None, None, 0), ("v", None, None, 0)}


def test_migration(engine, spark, tmp_path):
    engine.sql("CREATE STABLE st (ts TIMESTAMP, v FLOAT64) TAGS (site SYMBOL)")
    engine.sql("CREATE TABLE c1 USING st TAGS ('a')")
    engine.sql("CREATE TABLE t (ts TIMESTAMP, v FLOAT64) TIMESTAMP(ts)")
    engine.sql("INSERT INTO c1 VALUES ('2024-01-01', 1)")
    engine.sql("INSERT INTO t VALUES ('2024-01-01', 1), ('2024-01-05', 2)")
    other = Engine(spark, str(tmp_path / "there"))
    assert engine.migrate(other, ["c1", "t"]) == engine.migrate(other, ["c1", "t"]) == {"c1": 1, "t": 2}
    assert other.sql("SELECT site, v FROM st").first() == ("a", 1.0)
    other.sql("INSERT INTO t VALUES ('2024-01-06', 3)")
    with pytest.raises(QueryError):
        engine.migrate(other, ["t"], drop=True)
    engine.migrate(other, ["c1"], drop=True)
    assert "c1" not in engine.catalog["tables"] and other.sql("SELECT v FROM c1").count() == 1
