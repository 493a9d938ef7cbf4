"""Compares queries with their SQL in DuckDB, value by value."""

import datetime
import math
from collections import Counter

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, datetime.datetime) and v.tzinfo:
        return v.astimezone(datetime.UTC).replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def duck(sf_dir, sql, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def compare(df, sf_dir, sql, tables):
    names, rows = duck(sf_dir, sql, tables)
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    got = df.select(*[f"`{n}`" for n in names]).collect()
    a = Counter(tuple(plain(v) for v in r) for r in got)
    b = Counter(tuple(plain(v) for v in r) for r in rows)
    assert a == b, f"{len(got)} and {len(rows)} rows; only here {list((a - b).items())[:3]}; only there {list((b - a).items())[:3]}"
    return len(got)
