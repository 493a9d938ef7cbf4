"""Operator 10: SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is mapped to its bit counts in 2-bit segments, a point of a grid with 32 coordinates from 0
to 2. The Manhattan distance of two points is a lower bound of the Hamming distance, so fingerprints within
``distance`` bits lie within that Manhattan range. The range join runs on the grid: the coordinates fall
in distance + 3 groups, and a range of ``distance`` leaves at least three groups untouched, so the two points share
a cell for some choice of three groups. Inside a cell the bound prunes and the exact distance verifies.

Rows are first reduced to distinct fingerprints, so copies cost nothing. A cell emits a spanning forest of
its links (as many rows as members at most), never all its pairs. Cells over ``cell_rows`` members are dealt out
again by exact bits: 5 of 8 bytes, the other three free, which holds every link. Cells that are over it even then are not
gathered: each member names the points at most one flipped bit away and those at most two away, and members that meet at
a point are within three bits if one of them is within one. At most 1 + 24 + 276 distinct fingerprints can meet at a
point, so this ends the recursion. Components come from contraction rounds over the forest edges, all distributed.

Defined results: null texts and texts without words have fingerprint zero and link like any other; null
ids don't name a component unless all its ids are null (then component_id is null); repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import durable, small_batches, table, text_key

WORDS, SEED, DISTANCE = 3, 42, 3
CELL_ROWS = 20_000
EDGES_AT_ONCE = 2_000_000  # 32 MB of edges


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """Bit set where more than half the shingle hashes have it; 0 without words."""
    parts = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not parts:
        return 0
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    n = max(1, len(parts) - words + 1)
    ends = (starts + sizes)[words - 1 :] if len(parts) >= words else np.array([len(joined)])
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(joined[i:j], seed) for i, j in zip(starts[:n].tolist(), ends.tolist(), strict=True)), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    counts, step = np.zeros(64, np.int64), 1 << 15
    for k in range(0, len(hashes), step):
        counts += np.unpackbits(hashes[k : k + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(df: DataFrame, text: str = "text", words: int = WORDS, seed: int = SEED, to: str = "__fp") -> DataFrame:
    """All columns and the fingerprint as a signed long."""
    small_batches(df.sparkSession)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, words, seed) for t in batch.column(at).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], names=[*batch.schema.names, to])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(to, T.LongType())]))


def _cells(fp: np.ndarray, distance: int) -> list[np.ndarray]:
    """The cell of each fingerprint for every choice of three groups of grid coordinates."""
    even = np.uint64(0x5555555555555555)
    point = (fp & even) + ((fp >> np.uint64(1)) & even)  # 32 coordinates of two bits each
    groups = np.array_split(np.arange(32), distance + 3)
    masks = [np.uint64(sum(3 << (2 * int(c)) for c in g)) for g in groups]
    out = []
    for n, chosen in enumerate(combinations(masks, 3)):
        key = point & (chosen[0] | chosen[1] | chosen[2])
        out.append(_mix(key + np.uint64((n * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)))
    return out


def _exact_cells(fp: np.ndarray, distance: int) -> list[np.ndarray]:
    if distance > 3:
        raise ValueError("exact cells hold up to 3 differing bits")
    out = []
    for n, free in enumerate(combinations(range(8), distance)):
        mask = np.uint64(sum(0xFF << (8 * b) for b in range(8) if b not in free))
        out.append(_mix((fp & mask) + np.uint64((n * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)))
    return out


def _flips(free: tuple[int, ...], most: int) -> list[tuple[np.uint64, int]]:
    """Masks of up to ``most`` bits of the free bytes, with their number of bits."""
    bits = [8 * b + i for b in free for i in range(8)]
    return [(np.uint64(sum(1 << b for b in chosen)), k) for k in range(most + 1) for chosen in combinations(bits, k)]


def _meeting(cells: DataFrame, distance: int) -> DataFrame:
    """Edges (a, b) within exact cells (cell, fp): of two members within ``distance`` bits one is within half of it of a
    point that the other is within the other half of."""
    less, more = distance // 2, distance - distance // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for free, own in zip(combinations(range(8), distance), _exact_cells(fp, distance), strict=True):
                mine = own.view(np.int64) == cell
                if mine.any():
                    c, f = cell[mine], fp[mine]
                    for mask, k in _flips(free, more):
                        yield pa.record_batch([pa.array(c), pa.array((f ^ mask).view(np.int64)), pa.array(f.view(np.int64)), pa.array(np.full(len(f), k <= less))], names=["cell", "point", "fp", "near"])

    at = cells.mapInArrow(run, "cell long, point long, fp long, near boolean").groupBy("cell", "point")
    met = at.agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("a"), F.collect_set("fp").alias("bs")).where("a is not null and size(bs) > 1")
    return met.select("a", F.explode("bs").alias("b")).where("a <> b").distinct()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bound(apart: np.ndarray) -> np.ndarray:
    """Manhattan distance of grid points from their exclusive or: 01 and 11 are one step, 10 is two."""
    low = np.uint64(0x5555555555555555)
    one, two = apart & low, (apart >> np.uint64(1)) & low
    return np.bitwise_count(one) + 2 * np.bitwise_count(two & ~one)


def forest(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of spanning edges of the links among distinct fingerprints: none within a component already known."""
    fp = np.sort(fp)
    even = np.uint64(0x5555555555555555)
    point = (fp & even) + ((fp >> np.uint64(1)) & even)
    root = np.arange(len(fp))
    a: list[int] = []
    b: list[int] = []
    for i in range(len(fp) - 1):
        rest = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        rest = rest[_bound(point[rest] ^ point[i]) <= distance]
        for j in rest[np.bitwise_count(fp[rest] ^ fp[i]) <= distance].tolist():
            if root[j] != root[i]:
                a.append(i)
                b.append(j)
                root[root == root[j]] = root[i]
    return fp[a], fp[b]


def _join_cells(distance: int, cell_rows: int):
    """Links within each cell of a partition sorted by cell. Rows of cells over cell_rows come back as (fp, cell, True)."""

    def out(a, b, over):
        return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), over))], names=["a", "b", "over"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, fp, large = np.empty(0, np.int64), np.empty(0, np.uint64), None
        for batch in batches:
            cell = np.concatenate((cell, batch.column(0).to_numpy()))
            fp = np.concatenate((fp, batch.column(1).to_numpy().view(np.uint64)))
            whole = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0  # the last cell may go on
            yield from groups(cell[:whole], fp[:whole], large)
            if whole:
                large = None
            cell, fp = cell[whole:], fp[whole:]
            if len(cell) > cell_rows or large is not None:
                large = cell[0] if len(cell) else large
                yield out(fp, cell, True)
                cell, fp = cell[:0], fp[:0]
        yield from groups(cell, fp, large)

    def groups(cell, fp, large):
        if large is not None and len(cell):  # the rest of a cell that was already passed on
            n = int(np.searchsorted(cell, large, "right"))
            if n:
                yield out(fp[:n], cell[:n], True)
            cell, fp = cell[n:], fp[n:]
        if len(cell) < 2:
            return
        edge = np.flatnonzero(cell[1:] != cell[:-1]) + 1
        start = np.concatenate(([0], edge))
        size = np.diff(np.concatenate((start, [len(cell)])))
        few = np.repeat((size > 1) & (size <= 8), size)
        for d in range(1, 8):
            i = np.flatnonzero(few[:-d] & (cell[d:] == cell[:-d])) if len(cell) > d else ()
            if not len(i):
                break
            i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= distance]
            if len(i):
                yield out(fp[i], fp[i + d], False)
        for g in np.flatnonzero(size > 8).tolist():
            yield out(*forest(fp[start[g] : start[g] + size[g]], distance), False)

    return run


def links(prints: DataFrame, distance: int = DISTANCE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that join all that are linked."""

    def dealt(cells):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fp = batch.column(0).to_numpy().view(np.uint64)
                for key in cells(fp, distance):
                    yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64))], names=["cell", "fp"])

        return run

    def joined(df: DataFrame, rows: int) -> DataFrame:
        return df.repartition("cell").sortWithinPartitions("cell").mapInArrow(_join_cells(distance, rows), "a long, b long, over boolean")

    found = durable(joined(prints.select("fp").mapInArrow(dealt(_cells), "cell long, fp long"), cell_rows), "simhash-links")
    out = found.where("not over")
    hot = found.where("over")
    if not hot.isEmpty():
        fine = hot.select(F.col("a").alias("fp")).distinct().mapInArrow(dealt(_exact_cells), "cell long, fp long")
        found = durable(joined(fine, cell_rows), "simhash-fine")
        out = out.unionByName(found.where("not over"))
        hot = found.where("over")
        if not hot.isEmpty():
            out = out.unionByName(_meeting(hot.select(F.col("b").alias("cell"), F.col("a").alias("fp")), distance).withColumn("over", F.lit(False)))
    return durable(out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simhash-edges")


def joined_up(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the root of each: its component's least node."""
    node, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    up = np.arange(len(node))
    while True:
        ra, rb = up[a], up[b]
        apart = ra != rb
        if not apart.any():
            return node, node[up]
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(up, np.maximum(ra, rb), np.minimum(ra, rb))
        while (up[up] != up).any():
            up = up[up]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
        if got:
            node, root = joined_up(*(np.concatenate(x) for x in zip(*got, strict=True)))
            yield pa.record_batch([pa.array(node), pa.array(root)], names=["node", "root"])

    return edges.select("a", "b").repartition(1).mapInArrow(run, "node long, root long")


def components(edges: DataFrame, at_once: int = EDGES_AT_ONCE) -> DataFrame:
    """(node, root) for every node of the edges (a, b): rounds that hook each node to its least neighbour and contract.

    Every round at least halves the nodes that still have edges, so the rounds grow with the logarithm. Once at most
    ``at_once`` edges between contracted nodes are left, one task of that bounded size ends the work.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    done = None
    number = 0
    while True:
        if edges.count() <= at_once:
            last = durable(_in_one_task(edges), "components-last")
            if done is None:
                return last
            later = last.select(F.col("node").alias("root"), F.col("root").alias("__later"))
            return durable(done.join(later, "root", "left").select("node", F.coalesce("__later", "root").alias("root")), "components")
        number += 1
        # The order is drawn anew each round, so chains of hooks stay short.
        draw = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(number)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        up = both(edges).groupBy("a").agg(F.min(draw("b")).alias("m")).select(F.col("a").alias("node"), F.least(F.col("m"), draw("a"))["v"].alias("up"))
        up = durable(up, "components-up")
        while True:  # pointer jumping until every node points to a root
            over = up.alias("x").join(up.select(F.col("node").alias("n2"), F.col("up").alias("u2")), F.col("up") == F.col("n2"))
            over = durable(over.select("node", F.col("u2").alias("up"), (F.col("u2") != F.col("up")).alias("moved")), "components-jump")
            up = over.select("node", "up")
            if over.where("moved").isEmpty():
                break
        root_a, root_b = up.select(F.col("node").alias("a"), F.col("up").alias("ra")), up.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        edges = durable(edges.join(root_a, "a").join(root_b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "components-edges")
        if done is None:
            done = up.select("node", F.col("up").alias("root"))
        else:
            later = up.select(F.col("node").alias("root"), F.col("up").alias("__later"))
            done = durable(done.join(later, "root", "left").select("node", F.coalesce("__later", "root").alias("root")), "components")


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, distance: int = DISTANCE, seed: int = SEED, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, DataFrame]:
    """(key and __fp of every row, component of every fingerprint: __fp, __root, __component)."""
    rows = durable(with_fingerprints(df.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text")), "__text", words, seed).select("__key", "__fp"), "simhash-prints")
    return rows, named_components(rows, distance, cell_rows)


def named_components(rows: DataFrame, distance: int = DISTANCE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """__fp, __root, __component of every fingerprint of rows (__key, __fp)."""
    prints = rows.groupBy("__fp").agg(F.min("__key").alias("__least"))
    return named_by(prints, components(links(prints.select(F.col("__fp").alias("fp")), distance, cell_rows)))


def named_by(prints: DataFrame, root: DataFrame) -> DataFrame:
    """__fp, __root, __component of prints (__fp, __least) by the components (node, root)."""
    named = prints.join(root.select(F.col("node").alias("__fp"), F.col("root").alias("__r")), "__fp", "left").withColumn("__root", F.coalesce("__r", "__fp"))
    # One row a component, then back to its fingerprints: both sides hold distinct fingerprints only.
    named = durable(named.select("__fp", "__root", "__least"), "simhash-classes")
    least = named.groupBy("__root").agg(F.min("__least").alias("__component"))
    return named.select("__fp", "__root").join(least, "__root")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row: the key, fingerprint (16 hex digits), component_id (least key of its component)."""
    rows, named = classes(df, key, text, **options)
    out = rows.join(named.select("__fp", "__component"), "__fp")
    return out.select(F.col("__key").alias(key), F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), F.col("__component").alias("component_id"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, seed: int = SEED, **options) -> DataFrame:
    """The rows of df without near duplicates: of each component the row with the least key stays."""
    told = df.select(F.col(key).alias("__key"), *text_key(F.col(text).cast("string")), F.col(text).cast("string").alias("__text"))
    rows = durable(with_fingerprints(told, "__text", words, seed).drop("__text"), "simhash-prints")
    return keep_least(df, rows, named_components(rows, **options), key, text)


def keep_least(df: DataFrame, rows: DataFrame, named: DataFrame, key: str, text: str) -> DataFrame:
    """Of each component of named the row of df with the least key; rows has __key, __t1, __t2, __fp of every row."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0null"))
    # Of each component the rows with its key are left for the ranking: one, unless ids repeat.
    first = Window.partitionBy("__root").orderBy("__t1", "__t2")
    kept = rows.join(named, "__fp").where(F.col("__key").eqNullSafe(F.col("__component"))).withColumn("__k", F.row_number().over(first)).where("__k = 1")
    kept = durable(kept.select("__t1", "__t2", name("__key").alias("__name")), "simhash-kept")
    # Dealt by text and id, so copies don't meet in one task; a repeated row stays once.
    on = ["__t1", "__t2", "__name"]
    out = df.select("*", *text_key(F.col(text).cast("string")), name(key).alias("__name")).join(kept, on)
    out = out.withColumn("__k", F.row_number().over(Window.partitionBy(*on).orderBy("__name"))).where("__k = 1")
    return out.select(*[F.col(f"`{c}`") for c in df.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
