"""Top-k with repeated query rows against the SQL."""

import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import topk


@pytest.mark.parametrize("queries,floor", [(1 << 15, 4096), (3, 20)])
def test_repeated_queries_equal_sql(spark, queries, floor):
    r = random.Random(4)
    vector = lambda: [r.gauss(0, 0.3) for _ in range(6)]
    rows = [(i, vector()) for i in range(150)]
    rows += [rows[20]] * 2 + [rows[40]] * 60 + [(60, vector()), (60, vector())] + [rows[7]] * 30
    con = duckdb.connect()
    embeddings = pa.table({"vec_id": [i for i, _ in rows], "embedding": [v for _, v in rows]})
    con.register("embeddings", embeddings)
    want = sorted(con.execute(topk.ORACLE_SQL).fetchall())
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, block_rows=32, query_rows=queries, floor_rows=floor)
    assert sorted(map(tuple, got.collect())) == want


def test_every_query_row_has_its_own_ranking(spark):
    """A repeated query row, a repeated candidate and two vectors under one query id, by hand."""
    rows = [(20, [1.0, 0.0])] * 2 + [(40, [1.0, 0.0]), (40, [0.0, 1.0])] + [(7, [0.5, 0.0])] * 2 + [(33, [0.25, 1.0]), (46, [0.125, 0.5]), (59, [0.0, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, k=4).collect()))
    score = lambda a, b: sum(int(64 * x) * int(64 * y) for x, y in zip(a, b))
    want = []
    for q, v in rows:
        if q % 20 == 0:
            best = sorted((-score(v, w), i) for i, w in rows if i != q)[:4]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want) and len([x for x in got if x[0] == 20]) == 8
