"""Operator 2: best-fit packing by a grouping genetic algorithm on islands.

A document is its token ids and a separator. Documents over ``capacity`` are cut into pieces of that
length, the first one takes the remainder. Full pieces are sequences already; the others are dealt by hash into
cells of about ``cell_rows`` pieces. Each cell is evolved on ``islands`` islands with seeds of their own, from best fits
in noisy orders: a gene is a whole bin, crossover injects well-filled bins of one parent into the other, drops the bins
that held the same documents, dissolves loose ones, and best-fits the displaced documents; fewer bins win, then
fuller ones. An epoch ends at the lower bound or once crossovers bring no gain; then the best solution of every
island migrates to the next one. The best island's solution is kept. A
cell leaves at most a few open bins, so the loss against one global packing is a few sequences a cell; the
open bins of all cells are packed once more together, in cells again.

Defined results: null texts are empty: one separator, one piece; repeated rows are packed one by one; a
piece is never over the capacity; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import durable, small_batches, table

CAPACITY, SEPARATOR = 2048, 0
CELL_ROWS, ISLANDS, EPOCHS, CHILDREN, PATIENCE = 12_000, 2, 2, 60, 20
NOISE = (0.05, 0.1, 0.15)  # of the sizes by which a solution of the first generation orders its items
_loaded: dict = {}


class Ids:
    """Token ids of texts as the tokenizers library gives them for a byte-level BPE file.

    The same vocabulary runs about five times faster as ranks; that way is taken only for files whose ids are the merge
    ranks, and for texts of characters below U+0250 (whose classes all Unicode versions share) without
    the strings of added tokens. All others go to the library.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import json
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.no_truncation()
        self.slow.no_padding()
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        self.fast = None
        pre = held.get("pre_tokenizer") or {}
        plain = held.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        if held["model"].get("type") == "BPE" and plain:
            import tiktoken

            # The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 as it is, the rest from U+0100 on.
            same = [*range(33, 127), *range(161, 173), *range(174, 256)]
            back = {chr(b): b for b in same} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in same)}
            added = {t["content"] for t in held.get("added_tokens", [])}
            vocab, merges = held["model"]["vocab"], held["model"]["merges"]
            pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
            if all(vocab["".join(m)] == 256 + i for i, m in enumerate(pairs)):
                ranks = {bytes(back[c] for c in t): i for t, i in vocab.items() if t not in added}
                self.fast = tiktoken.Encoding("ranks", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.other = re.compile("|".join(["[^\x00-ɏ]", *map(re.escape, sorted(added))]))

    def __call__(self, texts: list[str]) -> Iterator[list[int]]:
        for t in texts:
            if self.fast and not self.other.search(t):
                yield self.fast.encode_ordinary(t)
            else:
                yield self.slow.encode(t, add_special_tokens=False).ids


def _ids(path: str) -> Ids:
    if path not in _loaded:
        _loaded[path] = Ids(path)
    return _loaded[path]


def pieces(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", separator: int = SEPARATOR) -> DataFrame:
    """Per piece: the key, piece, start, length, ids_crc32 and __row, a number no other piece has."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(key).alias(key), F.col(text).cast("string").alias("__text"))
    names = [key, "piece", "start", "length", "ids_crc32", "__row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids(tokenizer)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            took: list[int] = []
            out: list[tuple[int, int, int, int, int]] = []
            for i, got in enumerate(ids([t or "" for t in batch.column(1).to_pylist()])):
                got.append(separator)
                data, n = np.array(got, "<u4").tobytes(), len(got)
                start, piece = 0, 0
                while start < n:
                    length = capacity if start else (n - 1) % capacity + 1
                    took.append(i)
                    out.append((piece, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), number))
                    start, piece, number = start + length, piece + 1, number + 1
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.record_batch([batch.column(0).take(pa.array(took)), pa.array(cols[0], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=names)

    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, __row long")


def best_fit(items: np.ndarray, sizes: np.ndarray, capacity: int, room: list[tuple[int, int]], owner: np.ndarray, fresh: int) -> int:
    """Puts items, in their order, into the fullest bin that takes each; room is sorted (free, bin). Returns the next new bin."""
    for i, s in zip(items.tolist(), sizes[items].tolist(), strict=True):
        at = bisect_left(room, (s, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            free, b, fresh = capacity, fresh, fresh + 1
        owner[i] = b
        if free - s:
            insort(room, (free - s, b))
    return fresh


def fitness(owner: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins, then a larger sum of squared fill: smaller is better."""
    fill = np.bincount(owner, sizes)
    fill = fill[fill > 0]
    return len(fill), -float(((fill / capacity) ** 2).sum())


def crossover(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child of a with whole well-filled bins of b; bins of a that held the same items or are loosest are dissolved."""
    fill = np.bincount(b, sizes)
    good = np.flatnonzero(fill >= np.quantile(fill[fill > 0], 0.5))
    chosen = np.zeros(len(fill), bool)
    chosen[rng.choice(good, max(1, int(len(good) * rng.uniform(0.05, 0.6))), replace=False)] = True
    injected = chosen[b]
    load = np.bincount(a, sizes)
    hit = np.zeros(len(load), bool)
    hit[a[injected]] = True
    loose = np.flatnonzero((load > 0) & (load < capacity) & ~hit)
    hit[loose[np.argsort(load[loose], kind="stable")][: max(2, int(len(loose) * rng.uniform(0.05, 1)))]] = True
    child = a.copy()
    child[injected] = b[injected] + len(hit)
    displaced = np.flatnonzero(hit[a] & ~injected)
    fresh = len(hit) + len(fill)
    child[displaced] = fresh
    left, count = np.bincount(child, sizes), np.bincount(child)
    free = np.flatnonzero((count > 0) & (left < capacity))
    free = free[free != fresh]
    room = sorted(zip((capacity - left[free]).astype(int).tolist(), free.tolist(), strict=True))
    best_fit(displaced[np.argsort(-sizes[displaced], kind="stable")], sizes, capacity, room, child, fresh + 1)
    return np.unique(child, return_inverse=True)[1]


def evolve(sizes: np.ndarray, capacity: int, seed: int, children: int, known: list[np.ndarray], patience: int = PATIENCE) -> tuple[np.ndarray, int, int]:
    """(the best assignment of items to bins, crossovers, crossovers that gained). Starts from known solutions and noisy
    best fits; ends at the lower bound, after ``children`` crossovers or ``patience`` of them without a gain."""
    rng = np.random.default_rng(seed)
    people = [k.copy() for k in known]
    while len(people) < len(NOISE):
        noisy = sizes * (1 + NOISE[len(people)] * rng.standard_normal(len(sizes)))
        owner = np.zeros(len(sizes), np.int64)
        best_fit(np.argsort(-noisy, kind="stable"), sizes, capacity, [], owner, 0)
        people.append(owner)
    marks = [fitness(p, sizes, capacity) for p in people]
    bound = -(-int(sizes.sum()) // capacity)
    done = gains = idle = 0
    while done < children and idle < patience and (min(marks)[0] > bound or not done):
        i, j = rng.choice(len(people), 2, replace=False)
        if marks[j] < marks[i]:
            i, j = j, i
        child = crossover(people[i], people[j], sizes, capacity, rng)
        mark, worst = fitness(child, sizes, capacity), int(max(range(len(people)), key=marks.__getitem__))
        done, idle = done + 1, idle + 1
        if mark < marks[worst]:
            gains += mark < min(marks)
            people[worst], marks[worst], idle = child, mark, 0
    return people[int(min(range(len(people)), key=marks.__getitem__))], done, gains


def pack(parts: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", cell_rows: int = CELL_ROWS, islands: int = ISLANDS, epochs: int = EPOCHS, children: int = CHILDREN) -> DataFrame:
    """Adds sequence_id and offset to pieces."""
    full = parts.where(F.col("length") == capacity).withColumn("sequence_id", -F.col("__row") - 1).withColumn("offset", F.lit(0).cast("long"))
    items = parts.where(F.col("length") < capacity).select("__row", F.col("length").cast("int").alias("size"))

    def solved(items: DataFrame, cells: int, name: str) -> DataFrame:
        """__row, cell, bin, fill (of the bin) by the best island of each cell."""
        rows = items.withColumn("cell", F.pmod(F.xxhash64("__row", F.lit(name)), F.lit(cells)).cast("int"))
        rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island")).withColumn("bin", F.lit(-1)).withColumn("source", F.lit(0))

        def step(epoch: int):
            def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
                cell, island = (int(x) for x in key)
                pdf = pdf.sort_values(["source", "__row"], kind="stable")
                groups = [g for _, g in pdf.groupby("source", sort=True)]
                sizes = groups[0]["size"].to_numpy(np.int64)
                known = [g["bin"].to_numpy(np.int64) for g in groups if g["bin"].iloc[0] >= 0]
                best, done, gains = evolve(sizes, capacity, (cell * 31 + island) * 7 + epoch * 2 + island, children, known)
                best = np.unique(best, return_inverse=True)[1]
                bins, mark = fitness(best, sizes, capacity)
                return pd.DataFrame({"__row": groups[0]["__row"].to_numpy(), "size": sizes.astype(np.int32), "cell": np.int32(cell), "island": np.int32(island), "bin": best.astype(np.int32), "fill": np.bincount(best, sizes)[best].astype(np.int32), "bins": np.int32(bins), "mark": mark, "crossovers": np.int32(done), "gains": np.int32(gains)})

            return run

        out = None
        for epoch in range(epochs):
            out = rows.groupBy("cell", "island").applyInPandas(step(epoch), "__row long, size int, cell int, island int, bin int, fill int, bins int, mark double, crossovers int, gains int")
            out = durable(out, f"islands-{name}")
            if epoch + 1 < epochs:  # the elite of every island goes to the next one too
                own = out.select("__row", "size", "cell", "island", "bin", F.lit(0).alias("source"))
                rows = own.unionByName(own.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int")).withColumn("source", F.lit(1))) if islands > 1 else own
        best = out.groupBy("cell").agg(F.min(F.struct("bins", "mark", "island"))["island"].alias("island"))
        return out.join(best, ["cell", "island"]).select("__row", "size", "cell", "bin", "fill")

    n = items.count()
    cells = max(1, -(-n // cell_rows))
    first = durable(solved(items, cells, "first"), "packed")
    numbered = lambda df, top: df.select("__row", "cell", "bin", ((F.lit(top).cast("long") * (1 << 59)) + F.col("cell").cast("long") * (1 << 24) + F.col("bin")).alias("sequence_id"))
    placed = numbered(first, 0)
    loose = first.where(F.col("fill") < int(0.97 * capacity))
    left = loose.count() if cells > 1 else 0
    if left:
        again = durable(solved(loose.select("__row", "size"), max(1, -(-left // cell_rows)), "again"), "repacked")
        placed = numbered(first.where(F.col("fill") >= int(0.97 * capacity)), 0).unionByName(numbered(again, 1))
    joined = parts.join(placed.select("__row", "sequence_id"), "__row").repartition("sequence_id").sortWithinPartitions("sequence_id", "__row")

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, 0
        for batch in batches:
            out = []
            for s, n in zip(batch.column("sequence_id").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if s != last:
                    last, at = s, 0
                out.append(at)
                at += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "offset"])

    with_offsets = joined.mapInArrow(offsets, full.select(*joined.columns, "offset").schema)
    names = [key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return with_offsets.select(*names).unionByName(full.select(*names))


def pack_documents(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, **options) -> DataFrame:
    """Per piece: the key, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(durable(pieces(df, tokenizer, capacity, key, text), "pieces"), capacity, key, **options)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
