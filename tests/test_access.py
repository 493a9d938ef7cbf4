"""Users and privileges, audit records, deadlines, and queries over several stores."""

import pytest

from tidemark.plans.lexer import QueryError
from tidemark.sources.access import Denied
from tidemark.sources.engine import Engine
from tidemark.sources.federation import Federation


def test_users_audit_and_deadline(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), audit=True)
    e.sql("CREATE TABLE t (ts TIMESTAMP, v INT64) TIMESTAMP(ts)")
    e.sql("CREATE TABLE u (ts TIMESTAMP, w INT64) TIMESTAMP(ts)")
    e.sql("CREATE USER root IDENTIFIED BY 'pw' ROLE ADMIN")
    e.sql("CREATE USER ann IDENTIFIED BY 'se''cret' ROLE NORMAL")
    e.sql("GRANT SELECT ON t TO ann", "root")
    assert e.sql("SELECT count(*) AS n FROM t", "ann").first().n == 0
    for text in ("SELECT v FROM u", "SELECT v, w FROM t ASOF JOIN u", "INSERT INTO t VALUES ('2024-01-01', 1)", "DROP TABLE t", "LIST TABLES", "LIST USERS", "GRANT ALL ON * TO ann", "DELETE FROM t WHERE ts < '2024-01-01'", "CREATE GROUP g"):
        with pytest.raises(Denied):
            e.sql(text, "ann")
    e.sql("GRANT ALL ON * TO ann")
    e.sql("INSERT INTO t VALUES ('2024-01-01', 1)", "ann")
    with pytest.raises(Denied):
        e.sql("CREATE USER bob IDENTIFIED BY 'x'", "ann")
    e.sql("REVOKE ALL ON * FROM ann")
    e.sql("REVOKE INSERT ON t FROM ann")
    assert [tuple(r) for r in e.sql("LIST USERS", "root").collect()] == [("ann", "NORMAL", "SELECT ON t"), ("root", "ADMIN", "")]
    again = Engine(spark, e.root)
    assert again.access.authenticate("ann", "se'cret") and not again.access.authenticate("ann", "no") and not again.access.authenticate("bob", "x")
    e.sql("ALTER USER ann IDENTIFIED BY 'new'")
    assert e.access.authenticate("ann", "new") and not e.access.authenticate("ann", "se'cret")
    e.sql("DROP USER ann")
    for text, user in (("SELECT v FROM t", "ann"), ("DROP USER ann", None), ("GRANT SELECT ON t TO ann", None), ("CREATE USER root IDENTIFIED BY 'x'", None), ("GRANT READ ON t TO root", None), ("CREATE USER c IDENTIFIED BY 'x' ROLE KING", None), ("REVOKE ALL ON t TO root", None)):
        with pytest.raises(QueryError):
            e.sql(text, user)
    log = e.audit_log().collect()
    assert {(r.user, r.event, r.action, r.object, r.ok) for r in log} >= {("ann", "QUERY", "SELECT", "t", True), ("ann", "QUERY", "SELECT", "t, u", False), ("ann", "DATA", "INSERT INTO", "t", True), ("", "AUTH", "DROP USER", "ann", True), ("", "INVALID", "", "", False), ("ann", "DDL", "DROP TABLE", "t", False)}
    assert not any("pw" in str(r) or "cret" in str(r) for r in log)
    assert Engine(spark, str(tmp_path / "other")).audit_log().count() == 0
    assert e.collect("SELECT v FROM t", 600)[0].v == 1
    e.register("slow", spark.range(10**11).selectExpr("id % 1000003 AS v"))
    with pytest.raises(TimeoutError):
        e.collect("SELECT sum(v) AS s FROM slow", 1)


def test_federation_misses_are_counted(spark, tmp_path):
    east, west = (Engine(spark, str(tmp_path / x)) for x in ("east", "west"))
    for e, v in ((east, "1), ('2024-01-02', 2), ('2024-01-02', 3"), (west, "10")):
        e.sql("CREATE TABLE cpu (ts TIMESTAMP, v FLOAT64) TIMESTAMP(ts)")
        e.sql(f"INSERT INTO cpu VALUES ('2024-01-01', {v})")
    f = Federation(spark, [("cpu", east.root), ("c*", west.root)])
    f.add("*", str(tmp_path / "lost"))
    df, missed = f.sql("SELECT avg(v) AS a, count(*) AS n FROM cpu")
    assert tuple(df.first()) == (4.0, 4) and missed == [str(tmp_path / "lost")]
    df, _ = f.sql("SELECT time_bucket(ts, 1d) AS b, sum(v) AS s FROM cpu WHERE ts >= '2024-01-01' SAMPLE BY 1d ORDER BY b")
    assert [r.s for r in df.collect()] == [11.0, 5.0]
    for text in ("SELECT v FROM mem", "DROP TABLE cpu"):
        with pytest.raises(QueryError):
            f.sql(text)
