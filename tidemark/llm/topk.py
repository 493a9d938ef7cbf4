"""Operator 8: exact top-k by inner product with Fagin's threshold algorithm.

Candidates lie in blocks of at most ``block_rows`` vectors. A block sorts its vectors along every
dimension; a query reads each list from the end its own sign asks for. At depth t the threshold
sum(|q_d| * list_d[t]) bounds the score of every vector that no list has shown yet. Depth doubles; vectors seen so
far are scored exactly; the query stops at the first depth whose threshold is below its k-th score
(equal scores go on, as a smaller id may still win). The k-th score of a first, bounded set of rows is a floor
for every block, so most blocks stop early and return few rows.

Queries go out in broadcasts of at most ``query_rows`` vectors, one pass over the candidates each; blocks
return at most k rows a query and block, and those that can't reach the floor return none.

Defined results: vectors that are null, or hold null, NaN or infinite components, take no part, nor do rows with a
null id. Components beyond a vector's length count as zero. A row with the query's own id is never its
candidate. Ties go to the smaller id; a repeated row of another id keeps its place in the ranking. Every query row has
ranks from 1 to k of its own: equal query rows are searched once and answered each, rows of one id with different
vectors have a ranking each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import durable, table

BLOCK_ROWS, QUERY_ROWS, FLOOR_ROWS = 8192, 1 << 15, 4096


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component x as double; null where a component is null or not finite."""
    double = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(double, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.when(fine, F.transform(double, lambda x: F.floor(x * scale)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.float64)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Block:
    """Sorted lists of a block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        n = len(ids)
        rank = np.argsort(-self.vectors, axis=0, kind="stable")  # per dimension, best first
        self.best = np.take_along_axis(self.vectors, rank, axis=0)
        self.depths = sorted({min(n, d) for d in (max(1, n // 64), n // 16 + 1, n // 8 + 1, n // 4 + 1, n // 2 + 1, n)})
        width = vectors.shape[1]
        self.seen = []  # per depth: bit sets [2, dimension, bytes] of what either end of a list has shown
        for d in self.depths:
            marks = np.zeros((2, width, n), bool)
            np.put_along_axis(marks[0], rank[:d].T, True, axis=1)
            np.put_along_axis(marks[1], rank[n - d :].T, True, axis=1)
            self.seen.append(np.packbits(marks, axis=2))

    def search(self, qid: int, q: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the block's best k for q, without those below floor."""
        n, used = len(self.ids), np.flatnonzero(q)
        end = (q[used] < 0).astype(int)
        scored = np.zeros(n, bool)
        at, score = np.empty(0, np.int64), np.empty(0)
        for d, seen in zip(self.depths, self.seen, strict=True):
            shown = np.unpackbits(np.bitwise_or.reduce(seen[end, used], axis=0), count=n).astype(bool) if len(used) and d < n else np.ones(n, bool)
            new = np.flatnonzero(shown & ~scored)
            scored |= shown
            if len(new):
                at, score = np.concatenate((at, new)), np.concatenate((score, self.vectors[new] @ q))
                ok = (score >= floor) & (self.ids[at] != qid)
                at, score = at[ok], score[ok]
                if len(at) > k:
                    kth = np.partition(score, len(score) - k)[-k]
                    at, score = at[score >= kth], score[score >= kth]
            limit = max(floor, score.min() if len(at) >= k else -np.inf)
            if d == n:
                break
            bound = float(np.abs(q[used]) @ np.where(end == 0, self.best[d - 1, used], -self.best[n - d, used]))
            if bound < limit:
                break
        first = np.lexsort((self.ids[at], -score))[:k]
        return self.ids[at[first]], score[first]


def _scan(rows: DataFrame, held, k: int, width: int, block_rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, qids, queries, floors = held.value
        ids: list[np.ndarray] = []
        vectors: list[np.ndarray] = []

        def flush():
            block = Block(np.concatenate(ids), np.concatenate(vectors))
            out: list[tuple] = []
            for i in range(len(qids)):
                got, score = block.search(qids[i], queries[i], k, floors[i])
                if len(got):
                    floors[i] = max(floors[i], score[-1]) if len(got) == k else floors[i]
                    out.append((np.full(len(got), numbers[i]), got, score))
            ids.clear()
            vectors.clear()
            for c in range(0, len(out), 4096):
                part = [np.concatenate(x) for x in zip(*out[c : c + 4096], strict=True)]
                yield pa.record_batch([pa.array(part[0]), pa.array(part[1]), pa.array(part[2].astype(np.int64))], names=["query", "vec_id", "score"])

        floors = floors.copy()
        for batch in batches:
            for c in range(0, batch.num_rows, block_rows):
                piece = batch.slice(c, block_rows)
                if ids and sum(map(len, ids)) + piece.num_rows > block_rows:
                    yield from flush()
                ids.append(piece.column(0).to_numpy())
                vectors.append(_matrix(pa.concat_arrays([piece.column(1)]), width))
        if ids:
            yield from flush()

    return rows.select("vec_id", "q", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int")))).select("vec_id", "q").mapInArrow(run, "query long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def top_k(df: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: int = 64,
          block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, floor_rows: int = FLOOR_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score for every row where is_query holds, against all other rows."""
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("vec_id"), quantised(F.col(vector), scale).alias("q"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    # Of equal candidates no more than k can have a place.
    rows = rows.where("q is not null and vec_id is not null").groupBy("vec_id", "q").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("n"), F.count_if("asks").alias("asks"))
    rows = durable(rows, "vectors")
    n, asking, width = rows.agg(F.sum("n"), F.count_if(F.col("asks") > 0), F.max(F.size("q"))).first()
    n = n or 0
    parts, out, names = max(1, -(-asking // query_rows)), None, []
    for part in range(parts):
        mine = rows.where((F.col("asks") > 0) & (F.pmod(F.xxhash64("vec_id", "q"), F.lit(parts)) == part))
        got = mine.select("vec_id", "q", "asks").toArrow()  # distinct, so about query_rows of them
        if not got.num_rows:
            continue
        got = got.combine_chunks()
        column = got.column(1).chunk(0)
        qids, queries = got.column(0).to_numpy(), _matrix(column, width)
        numbers, none = (part << 32) + np.arange(len(qids)), np.full(len(qids), -np.inf)
        names.append(spark.createDataFrame(pa.table({"query": numbers, "query_id": qids, "times": got.column(2).to_numpy()})))
        floors = none
        if n > 4 * floor_rows:
            # Any rows give a floor that holds; these are the first of a hash order, at most floor_rows or so.
            some = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(part)), F.lit(max(1, n // floor_rows))) == 0)
            low = _ranked(_scan(some.coalesce(1), spark.sparkContext.broadcast((numbers, qids, queries, none)), k, width, block_rows), k)
            low = low.groupBy("query").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("c")).where(F.col("c") == k).select("query", "low").toArrow()
            at = dict(zip(low.column(0).to_pylist(), low.column(1).to_pylist(), strict=True))
            floors = np.array([at.get(i, -np.inf) for i in numbers.tolist()], np.float64)
        found = _scan(rows.repartition(max(1, -(-n // block_rows)), F.xxhash64("vec_id", "q")), spark.sparkContext.broadcast((numbers, qids, queries, floors)), k, width, block_rows)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    named = reduce(DataFrame.unionByName, names).withColumn("times", F.array_repeat(F.lit(0), F.col("times").cast("int")))
    return _ranked(out, k).join(named, "query").select("query_id", "rank", "vec_id", "score", F.explode("times")).drop("col")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows, F.col("vec_id") % 20 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS nr, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.nr, a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY nr ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
