"""Near copies for the pipeline: rows whose sets of five-word shingles have a Jaccard similarity of 0.8 and more.

Candidates come from operator 10, SimHash fingerprints of the shingles linked by its grid join, and, since most pairs at
the threshold are 5 to 14 bits apart and so beyond any radius that the grid can be searched with, from MinHash
bands as well: 60 cells a set, each named by five minima. Two sets at the threshold share no cell with a chance of
(1 - 0.8 ** 5) ** 60, under 1e-10; more similar sets with less. Sets that share cells or are linked, directly
or by way of others, are one candidate group. A group is gathered once with whole shingle sets and its pairs are
tested exactly, so no candidate counts as a copy unverified. Groups over ``group`` shingles are cut into blocks, and
every two blocks meet in a task of their own: all pairs are still tested, and no task holds more than two blocks.

Rows are first reduced to distinct sets (64-bit hashes), so copies cost nothing, and a task emits a spanning forest
of the links, never all pairs. Texts with fewer words than a shingle are one shingle; null texts and texts without words
have the empty set and are copies of each other. Links are transitive, as in ``simhash.keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import durable, small_batches, text_key
from .simhash import DISTANCE, _mix, components, keep_least, majority, named_by
from .simhash import links as simhash_links

WORDS, SIMILARITY, SEED = 5, 0.8, 42
BANDS, MINIMA = 60, 5
GROUP = 1 << 20
BROADCAST_ROWS = 200_000


def shingles(text: str | None, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Sorted distinct hashes of the shingles; words are cut as for the fingerprint."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    n = max(1, len(parts) - words + 1)
    ends = (starts + sizes)[words - 1 :] if len(parts) >= words else np.array([len(joined)])
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[i:j], seed) for i, j in zip(starts[:n].tolist(), ends.tolist(), strict=True)), np.uint64, n))


def _factors() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 64, BANDS * MINIMA, np.uint64) | np.uint64(1)


def bands(found: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The cells of a set that isn't empty."""
    low = np.full(len(factors), (1 << 64) - 1, np.uint64)
    for k in range(0, len(found), 128):
        np.minimum(low, (found[k : k + 128, None] * factors).min(axis=0), out=low)
    key = np.arange(BANDS, dtype=np.uint64)
    for minima in low.reshape(BANDS, MINIMA).T:
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + minima)
    return key


def _with_bands(df: DataFrame) -> DataFrame:
    """The columns but __text, and __fp (hash of the shingle set), __n (its size), __sim (its SimHash), __bands (none of an empty set)."""
    small_batches(df.sparkSession)
    at, factors = df.columns.index("__text"), _factors()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column(at).to_pylist()]
            fp = np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets), np.uint64, len(sets))
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            sim = np.fromiter(map(majority, sets), np.uint64, len(sets))
            cells = [bands(s, factors) for s in sets if len(s)]
            flat = np.concatenate(cells) if cells else np.empty(0, np.uint64)
            offsets = np.concatenate(([0], np.cumsum((n > 0) * BANDS))).astype(np.int32)
            kept = [c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != "__text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(fp.view(np.int64)), pa.array(n), pa.array(sim.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))], names=names)

    fields = [f for f in df.schema.fields if f.name != "__text"] + [T.StructField("__fp", T.LongType()), T.StructField("__n", T.LongType()), T.StructField("__sim", T.LongType()), T.StructField("__bands", T.ArrayType(T.LongType()))]
    names = [f.name for f in fields]
    return df.mapInArrow(run, T.StructType(fields))


def forest(fp: np.ndarray, sets: list[np.ndarray], similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Ends of spanning edges of the links among distinct sets that aren't empty."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    fp, sets = fp[order], [sets[i] for i in order]
    size = np.array([len(s) for s in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[at] > 1  # what one set alone holds is in no overlap
    edge = np.concatenate(([0], np.cumsum(size)))
    edge = np.concatenate(([0], np.cumsum(shared)))[edge]
    at = at[shared]
    mark = np.zeros(len(times), bool)
    root = np.arange(len(fp))
    a: list[int] = []
    b: list[int] = []
    for i in range(len(fp) - 1):
        end = int(np.searchsorted(size, size[i] / similarity + 1e-6, "right"))
        rest = np.flatnonzero(root[i + 1 : end] != root[i]) + i + 1
        if not len(rest):
            continue
        mark[at[edge[i] : edge[i + 1]]] = True
        if len(rest) <= 16:
            both = np.array([np.count_nonzero(mark[at[edge[j] : edge[j + 1]]]) for j in rest])
        else:
            lo = edge[rest[0]]
            total = np.concatenate(([0], np.cumsum(mark[at[lo : edge[rest[-1] + 1]]])))
            both = total[edge[rest + 1] - lo] - total[edge[rest] - lo]
        mark[at[edge[i] : edge[i + 1]]] = False
        for j in rest[both / (size[i] + size[rest] - both) >= similarity].tolist():
            if root[j] != root[i]:
                a.append(i)
                b.append(j)
                root[root == root[j]] = root[i]
    return fp[a], fp[b]


def _gathered(df: DataFrame) -> DataFrame:
    """The set of each row once for every pair of blocks that it belongs to; of copies in a task the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for text, fp, root, block, blocks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if fp in seen:
                    continue
                seen.add(fp)
                pairs = [(min(block, q), max(block, q)) for q in range(blocks) if q != block] or [(0, 0)]
                held = shingles(text).tobytes()
                for c in range(0, len(pairs), 64):
                    x, y = zip(*pairs[c : c + 64], strict=True)
                    n = len(x)
                    yield pa.record_batch([pa.array([root] * n, pa.int64()), pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array([fp] * n, pa.int64()), pa.array([held] * n, pa.binary())], names=["root", "x", "y", "fp", "held"])

    return df.select("__text", "__fp", "__root", "__block", "__blocks").mapInArrow(run, "root long, x long, y long, fp long, held binary")


def _tested(df: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) within each (root, x, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, {}

        def flush():
            if len(held) > 1:
                a, b = forest(np.fromiter(held, np.int64, len(held)), list(held.values()), similarity)
                yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            for root, x, y, fp, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (root, x, y) != last:
                    yield from flush()
                    last, held = (root, x, y), {}
                held[fp] = np.frombuffer(s, np.uint64)
        yield from flush()

    on = ["root", "x", "y"]
    return df.repartition(*on).sortWithinPartitions(*on).mapInArrow(run, "a long, b long")


def candidates(sets: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) that join the sets (__fp, __sim, __bands) of each candidate group."""
    cells = sets.select("__fp", F.explode("__bands").alias("cell"))
    cells = cells.withColumn("a", F.min("__fp").over(Window.partitionBy("cell"))).where("a <> __fp")
    hubs = durable(sets.groupBy("__sim").agg(F.min("__fp").alias("hub")), "near-hubs")
    alike = sets.join(hubs, "__sim").where("hub <> __fp").select(F.col("hub").alias("a"), F.col("__fp").alias("b"))
    end = lambda c: hubs.select(F.col("__sim").alias(c), F.col("hub").alias(f"hub_{c}"))
    linked = simhash_links(hubs.select(F.col("__sim").alias("fp")), distance).join(end("a"), "a").join(end("b"), "b").select(F.col("hub_a").alias("a"), F.col("hub_b").alias("b"))
    return cells.select("a", F.col("__fp").alias("b")).unionByName(alike).unionByName(linked).distinct()


def links(told: DataFrame, rows: DataFrame, similarity: float = SIMILARITY, group: int = GROUP) -> DataFrame:
    """Edges (a, b) between sets that join all that are linked; told has __t1, __t2, __text, rows is durable."""
    sets = rows.where("__n > 0").groupBy("__fp").agg(F.min(F.struct("__t1", "__t2")).alias("__t"), F.first("__n").alias("__n"), F.first("__sim").alias("__sim"), F.first("__bands").alias("__bands"))
    near = components(durable(candidates(sets), "near-cells"))
    size = sets.select("__fp", "__t", "__n").join(near.select(F.col("node").alias("__fp"), F.col("root").alias("__root")), "__fp")
    size = durable(size, "near-groups")
    blocks = size.groupBy("__root").agg(F.ceil(F.sum("__n") / group).cast("long").alias("__blocks"))
    asked = size.join(blocks, "__root").select("__fp", "__root", "__blocks", F.pmod(F.xxhash64("__fp"), "__blocks").alias("__block"), F.col("__t.__t1").alias("__t1"), F.col("__t.__t2").alias("__t2"))
    asked = durable(asked, "near-asked")
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
    return durable(_tested(_gathered(told.join(asked, ["__t1", "__t2"])), similarity).distinct(), "near-edges")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of df without near copies: of each component the row with the least key stays."""
    told = df.select(F.col(key).alias("__key"), *text_key(F.col(text).cast("string")), F.col(text).cast("string").alias("__text"))
    rows = durable(_with_bands(told), "near-prints")
    prints = rows.groupBy("__fp").agg(F.min("__key").alias("__least"))
    named = named_by(prints, components(links(told.drop("__key"), rows, **options)))
    return keep_least(df, rows.select("__key", "__t1", "__t2", "__fp"), named, key, text)
