"""Operator 6: toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: words (ASCII letters and digits and all other letters outside ASCII, lower-cased in ASCII), pairs of
neighbours and pairs with one word skipped, hashed to 2 ** ``bits`` weights; each counts once. FTRL-proximal keeps z
and n per coordinate (a learning rate of its own) and L1 holds weights at exactly zero, so the model that is
broadcast is a short list of (feature, weight). Training runs in ``shards`` parts whose weights are
averaged after every epoch and start the next one.

Labels come from a sample of at most about ``max_train`` labelled rows, chosen by hash of the id; rows with
crc32(id) mod 5 = 0 are never learned from. Everything is scored on its whole text.

Defined results: null and empty texts have the score of the bias alone; without labels every score is 0; labels repeated for an
id count as toxic if one does; null labels teach nothing; repeated rows are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import durable, small_batches, table

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_is_word = np.zeros(256, bool)
_is_word[48:58] = _is_word[97:123] = True
_is_word[128:] = True
_code = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_SLICE = 1 << 19
_powers = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


@dataclass(frozen=True)
class Params:
    bits: int = 20
    max_train: int = 24_000
    shards: int = 2
    epochs: int = 3
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.1
    threshold: float = 0.5


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * _SLICE)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of UTF-8 bytes."""
    data = _lower[data]
    inside = _is_word[data]
    turn = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    start, end = turn[0::2], turn[1::2]
    up, down = _pow(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_code[data] * up[: len(data)], out=total[1:])
    return start, _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def features(texts: list[str], bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(text number, hashed features, repeats included) in order; a long text comes as several pieces."""
    block: list[tuple[int, bytes]] = []

    def flush():
        whole = b"\n".join(b for _, b in block)
        start, h = word_hashes(np.frombuffer(whole, np.uint8))
        begin = np.cumsum([0] + [len(b) + 1 for _, b in block])
        cut = np.searchsorted(start, begin)
        shift = np.uint64(64 - bits)
        one = (_mix(h) >> shift).astype(np.int64)
        two = (_mix(h[:-1] * np.uint64(3) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> shift).astype(np.int64)
        skip = (_mix(h[:-2] * np.uint64(5) + h[2:] * np.uint64(0x165667B19E3779F9)) >> shift).astype(np.int64)
        for (i, _), a, b in zip(block, cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            yield i, np.concatenate((one[a:b], two[a : max(a, b - 1)], skip[a : max(a, b - 2)]))

    held = 0
    for i, t in enumerate(texts):
        b = t.encode()
        while True:
            if len(b) <= _SLICE:
                piece, b = b, b""
            else:  # cut between words, two words overlap
                at = b.rfind(b" ", 1, _SLICE) if b" " in b[1:_SLICE] else _SLICE
                back = b.rfind(b" ", 0, b.rfind(b" ", 0, at)) if at != _SLICE else at
                piece, b = b[:at], b[back if 0 < back < at else at :]
            if held and held + len(piece) > _SLICE:
                yield from flush()
                block.clear()
                held = 0
            block.append((i, piece))
            held += len(piece)
            if not b:
                break
    if block:
        yield from flush()


class Ftrl:
    def __init__(self, p: Params, start: dict[int, float] | None = None):
        self.p, size = p, (1 << p.bits) + 1  # the last weight is the bias
        self.z, self.n = np.zeros(size, np.float64), np.zeros(size, np.float64)
        for i, w in (start or {}).items():  # z that gives back the averaged weight
            self.z[i] = -w * (p.beta / p.alpha + p.l2) - np.sign(w) * p.l1

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.p.l1) / ((self.p.beta + np.sqrt(self.n[at])) / self.p.alpha + self.p.l2)
        return np.where(np.abs(z) <= self.p.l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.p.alpha * w
        self.n[at] = n + g * g


def _epoch(p: Params, started: dict[int, float]):
    """One pass over each shard of a partition sorted by shard; (-1, 1) stands for the shard itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, shard = None, None

        def done():
            w = model.weights(np.arange(len(model.z)))
            at = np.flatnonzero(w)
            return pa.record_batch([pa.array(np.append(at, -1)), pa.array(np.append(w[at], 1.0))], names=["at", "w"])

        for batch in batches:
            flat, ends = batch.column(2).flatten().to_numpy(), np.cumsum(np.diff(batch.column(2).offsets.to_numpy()))
            for i, (mine, label) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if mine != shard:
                    if model:
                        yield done()
                    model, shard = Ftrl(p, started), mine
                model.learn(flat[ends[i - 1] if i else 0 : ends[i]].astype(np.int64), label)
        if model:
            yield done()

    return run


def _fold(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, p: Params = Params(), key: str = "doc_id", text: str = "text", label: str = "toxic") -> dict[int, float]:
    """Non-zero weights by feature; feature 2 ** bits is the bias."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("__id")).agg(F.max(F.col(label).cast("int")).alias("__label"))
    known = known.where(_fold(F.col("__id")) != 0)
    n = known.count()
    if not n:
        return {}
    part = min(1.0, p.max_train / n)
    draw = F.pmod(F.xxhash64("__id"), F.lit(1_000_000))
    # About max_train rows of two numbers: the bound of the broadcast.
    sample = F.broadcast(known.where(draw < int(part * 1_000_000))) if p.max_train <= 1_000_000 else known.where(draw < int(part * 1_000_000))
    rows = docs.select(F.col(key).alias("__id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text")).join(sample, "__id").select("__id", "__label", "__text")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
            for i, f in features(batch.column(2).to_pylist(), p.bits):
                got[i].append(f)
            at = [np.unique(np.concatenate(g)).astype(np.int32) for g in got]
            yield pa.record_batch([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(at, pa.list_(pa.int32()))], names=["id", "label", "at"])

    data = rows.withColumn("__id", F.xxhash64("__id")).mapInArrow(sparse, "id long, label int, at array<int>")
    data = durable(data.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(p.shards)).cast("int")), "toxic-train")
    weights: dict[int, float] = {}
    for epoch in range(p.epochs):
        dealt = data.repartition(p.shards, "shard").sortWithinPartitions("shard", F.xxhash64("id", F.lit(epoch)), "id").select("shard", "label", "at")
        got = dealt.mapInArrow(_epoch(p, dict(weights)), "at long, w double").groupBy("at").agg(F.sum("w").alias("w"))
        weights = {int(r[0]): float(r[1]) for r in got.collect()}  # at most 2 ** bits + 2 numbers
        shards = weights.pop(-1, 1.0)
        weights = {i: w / shards for i, w in weights.items()}
    return weights


def _scored(p: Params, weights: dict[int, float]):
    """Texts to probabilities; the closure holds the sparse weights only."""
    at, w = np.array(list(weights), np.int64), np.array(list(weights.values()), np.float32)

    def prepare():
        full = np.zeros((1 << p.bits) + 1, np.float32)
        full[at] = w

        def score(texts: list[str | None]) -> np.ndarray:
            if not len(at):
                return np.zeros(len(texts))
            total = np.full(len(texts), float(full[-1]))
            held: dict[int, list[np.ndarray]] = {}
            for i, f in features([t or "" for t in texts], p.bits):
                f = f[full[f] != 0]
                if len(f):
                    held.setdefault(i, []).append(f)
            for i, f in held.items():
                total[i] += full[np.unique(np.concatenate(f))].sum(dtype=np.float64)
            return 1 / (1 + np.exp(-np.clip(total, -35, 35)))

        return score

    return prepare


def score(df: DataFrame, weights: dict[int, float], p: Params = Params(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, held_out, score, predicted."""
    small_batches(df.sparkSession)
    held = _scored(p, weights)
    rows = df.select(F.col(key).alias(key), F.coalesce(_fold(F.col(key)) == 0, F.lit(False)).alias("held_out"), F.col(text).cast("string").alias("__text"))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held()
        for batch in batches:
            s = model(batch.column(2).to_pylist())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= p.threshold).astype(np.int32))], names=[key, "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"`{key}` {kind}, held_out boolean, score double, predicted int")


def drop_toxic(df: DataFrame, weights: dict[int, float], p: Params = Params(), text: str = "text") -> DataFrame:
    """The rows of df, all columns, whose score is under the threshold."""
    small_batches(df.sparkSession)
    prepare, at = _scored(p, weights), df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = prepare()
        for batch in batches:
            yield batch.filter(pa.array(model(batch.column(at).to_pylist()) < p.threshold))

    return df.mapInArrow(run, df.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
