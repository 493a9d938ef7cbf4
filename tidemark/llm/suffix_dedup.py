"""Operator 4: exact repeated passages by prefix-free parsing.

Parsing. A rolling hash over ``gram`` bytes sets triggers: the (rightmost) least hash of each window of ``length``
bytes. Triggers depend on bytes near them alone, so every occurrence of a string is cut into the same phrases. Each
window of ``length`` bytes belongs to exactly one trigger, so windows of one trigger form one interval of starts, and
the bytes they span are the trigger's phrase. Equal windows have equal triggers at equal offsets.

Dictionary and parse. Phrases are keyed by 128 bits (trigger hash, phrase hash): the dictionary is the distinct
phrases with their counts, the parse the occurrences. Triggers that occur once have no repeated window and go first. A
phrase that occurs twice is repeated whole. Only the phrases of triggers with several distinct phrases are
ordered: one suffix array of the dictionary's phrase ends (what precedes the trigger, read backwards) and one of the
parse's continuations (what follows it), each with its common-prefix lengths. A window that starts d bytes
before the trigger is d bytes of the one and ``length`` - d of the other; its neighbours in corpus order are those
of equal rank at these depths in both arrays. That order is made for every d, a run of triggers at a time,
without one global array. Copies and repeated phrases are never expanded.

A trigger with more than ``group_rows`` distinct phrases (a line that a large part of the corpus holds, in
ever other surroundings) is known from the dictionary's counts and dealt to no task as a whole: its windows are keyed by
128 bits (trigger and window hash) and counted with partial aggregation.

Two lengths. Every repeat of ``length`` bytes lies in a repeat of fewer, so spans of a short length (passages) hold all
spans of a longer one; ``narrowed`` finds these in the short spans alone.

Texts are bytes in UTF-8. Defined results: null and empty texts have no bytes and nothing removed; texts shorter than
``length`` keep all; equal texts of at least ``length`` bytes lose all of it, in every copy; rows are answered one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import durable, release, small_batches, table

LENGTH, GROUP_ROWS = 400, 10_000
PASSAGE = 250  # bytes; 51 words of prose have more
ORDERED = 2000  # phrases ordered at once, besides the rest of a trigger
CHUNK = 1 << 18  # bytes parsed at once

_rng = np.random.default_rng(20240229)
_BYTES = [_rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1) for _ in range(3)]
_BASES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse modulo 2 ** 64."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK + 4096)
        base = _BASES[which]
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = _powers[which] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


def rolling(data: np.ndarray, width: int, which: int) -> np.ndarray:
    """The hash of every ``width`` bytes of data."""
    n = len(data)
    up, down = _tables(which, n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[which][data] * up[:n], out=total[1:])
    h = (total[width:] - total[:-width]) * down[: n - width + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def triggers(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For the windows of data by start: first start, last start, hash and place of the trigger of every run with one."""
    h = rolling(data, gram, 0)
    span = length - gram + 1
    n = len(data) - length + 1
    low = np.uint64((1 << 20) - 1)
    packed = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))  # ties: the rightmost
    padded = np.full(-(-len(h) // span) * span, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(h)] = packed
    cut = padded.reshape(-1, span)
    before = np.minimum.accumulate(cut, axis=1).ravel()
    after = np.minimum.accumulate(cut[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[:n], before[span - 1 : span - 1 + n])
    at = (low - (least & low)).astype(np.int64)
    edge = np.flatnonzero(at[1:] != at[:-1]) + 1
    first = np.concatenate(([0], edge))
    last = np.concatenate((edge - 1, [n - 1]))
    return first, last, h[at[first]], at[first]


def parse(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Per block of texts: (text number, first start, last start, trigger hash, phrase hash, trigger's place from the first start)."""
    block: list[tuple[int, int, bytes]] = []
    held = 0

    def flush():
        whole = b"".join(x[2] for x in block)
        first, last, key, place = triggers(np.frombuffer(whole, np.uint8), length, gram)
        sizes = np.array([len(x[2]) for x in block])
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        end = begin + sizes - length  # last start of a window that lies in one text
        # A run may reach over texts: one piece for each text that it has windows of.
        lo_doc = np.searchsorted(begin, first, "right") - 1
        hi_doc = np.searchsorted(begin, last, "right") - 1
        many = hi_doc - lo_doc + 1
        run = np.repeat(np.arange(len(first)), many)
        doc = lo_doc[run] + (np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many))
        a, b = np.maximum(first[run], begin[doc]), np.minimum(last[run], end[doc])
        ok = a <= b
        a, b, doc, run = a[ok], b[ok], doc[ok], run[ok]
        digest = xxhash.xxh3_64_intdigest
        phrase = np.fromiter((digest(whole[i : j + length]) for i, j in zip(a.tolist(), b.tolist(), strict=True)), np.uint64, len(a))
        number, base = np.array([x[0] for x in block])[doc], np.array([x[1] for x in block])[doc] - begin[doc]
        return number, a + base, b + base, key[run].view(np.int64), phrase.view(np.int64), place[run] - a

    for i, t in enumerate(texts):
        for k in range(0, max(0, len(t) - length + 1), CHUNK):
            piece = t[k : k + CHUNK + length - 1]
            if held and held + len(piece) > CHUNK + length:
                yield flush()
                block.clear()
                held = 0
            block.append((i, k, piece))
            held += len(piece)
    if block:
        yield flush()


def _occurrences(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """The parse of docs (t1, t2, data). A task parses equal texts twice at most: more occurrences change nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: set[tuple[int, int]] = set()
        twice: set[tuple[int, int]] = set()
        for batch in batches:
            keep = []
            t1, t2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for i, t in enumerate(zip(t1.tolist(), t2.tolist(), strict=True)):
                if t not in twice:
                    keep.append(i)
                    (twice if t in once else once).add(t)
            t1, t2 = t1[keep], t2[keep]
            for number, a, b, k, f, off in parse(batch.column(2).take(pa.array(keep, pa.int32())).to_pylist(), length, gram):
                cols = [k, f, t1[number], t2[number], a.astype(np.int32), b.astype(np.int32), off.astype(np.int32)]
                yield pa.record_batch([pa.array(c) for c in cols], names=["k", "f", "t1", "t2", "lo", "hi", "off"])

    return docs.mapInArrow(run, "k long, f long, t1 long, t2 long, lo int, hi int, off int")


def suffix_array(group: np.ndarray, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the parts within their groups, and the common prefix length of each with the one before it (-1: another group)."""
    order = np.array(sorted(range(len(parts)), key=lambda i: (group[i], parts[i])), np.int64)
    size = np.array([len(p) for p in parts])
    held = np.zeros((len(parts), int(size.max(initial=0)) + 1), np.uint8)
    held[np.repeat(np.arange(len(parts)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = np.frombuffer(b"".join(parts), np.uint8)
    a, b = order[:-1], order[1:]
    apart = held[a] != held[b]
    apart[:, -1] = True
    common = np.minimum(apart.argmax(axis=1), np.minimum(size[a], size[b]))
    common[group[a] != group[b]] = -1
    return order, np.concatenate(([-1], common))


def repeated_starts(group: np.ndarray, phrases: list[tuple[bytes, int]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the distinct phrases (bytes, trigger's place) of triggers (group): phrase, first and last start of runs of windows that occur twice."""
    off = np.array([o for _, o in phrases], np.int64)
    last = np.array([len(p) for p, _ in phrases], np.int64) - length
    order_d, common_d = suffix_array(group, [p[:o][::-1] for p, o in phrases])
    order_p, common_p = suffix_array(group, [p[o:] for p, o in phrases])
    m = len(phrases)
    depth = np.arange(max(0, int((off - last).min())), int(off.max()) + 1)
    # Ranks by the first d bytes of the one array and the first length - d of the other: equal ranks, equal bytes.
    rank_d, rank_p = np.empty((len(depth), m), np.int64), np.empty((len(depth), m), np.int64)
    rank_d[:, order_d] = np.cumsum(common_d[None, :] < depth[:, None], axis=1)
    rank_p[:, order_p] = np.cumsum(common_p[None, :] < (length - depth)[:, None], axis=1)
    key = rank_d * (m + 1) + rank_p
    here = (depth[:, None] <= off) & (off - depth[:, None] <= last)
    key = np.where(here, key, -1 - np.arange(m))
    corpus = np.argsort(key, axis=1, kind="stable")
    key = np.take_along_axis(key, corpus, axis=1)
    equal = np.zeros((len(depth), m + 1), bool)
    equal[:, 1:m] = key[:, 1:] == key[:, :-1]
    again = np.zeros((len(depth), m), bool)
    np.put_along_axis(again, corpus, equal[:, 1:] | equal[:, :-1], axis=1)
    edge = np.diff(np.pad(again.T.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    who, first = np.nonzero(edge == 1)
    after = np.nonzero(edge == -1)[1]
    return who, off[who] - depth[after - 1], off[who] - depth[first]


_PHRASES = "k long, t1 long, t2 long, lo int, off int, phrase binary"


def _phrases(cand: DataFrame, length: int, hot: bool) -> DataFrame:
    """The open phrases of the candidate texts with their bytes: those of hot triggers or of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for t1, t2, data, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += [(s["k"], t1, t2, s["lo"], s["off"], data[s["lo"] : s["hi"] + length]) for s in spans]
                if len(out) > 5000:
                    yield emit(out)
                    out = []
            if out:
                yield emit(out)

    def emit(out):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["k", "t1", "t2", "lo", "off", "phrase"])

    spans = F.filter("open", lambda s: s["hot"] == F.lit(hot))
    return cand.select("t1", "t2", "data", spans.alias("open")).where(F.size("open") > 0).mapInArrow(run, _PHRASES)


def _matched(phrases: DataFrame, length: int) -> DataFrame:
    """(t1, t2, a, b): runs of starts whose windows another phrase of the trigger holds too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []

        def solved(rows):
            keys = np.array([r[0] for r in rows], np.int64)
            who, a, b = repeated_starts(keys, [(p, off) for _, _, _, _, off, p in rows], length)
            t1, t2, lo = (np.array([r[i] for r in rows], np.int64)[who] for i in (1, 2, 3))
            return pa.record_batch([pa.array(t1), pa.array(t2), pa.array((lo + a).astype(np.int32)), pa.array((lo + b).astype(np.int32))], names=["t1", "t2", "a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(rows) >= ORDERED and row[0] != rows[-1][0]:
                    yield solved(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield solved(rows)

    return phrases.repartition("k").sortWithinPartitions("k").mapInArrow(run, "t1 long, t2 long, a int, b int")


def _windows(phrases: DataFrame, length: int) -> DataFrame:
    """Every window of phrases by trigger and hash: (k, w, t1, t2, pos)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t1, t2, lo, _, phrase in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = np.frombuffer(phrase, np.uint8)
                many = len(part) - length + 1
                cols = [np.full(many, k), rolling(part, length, 1).view(np.int64), np.full(many, t1), np.full(many, t2), np.arange(lo, lo + many, dtype=np.int32)]
                yield pa.record_batch([pa.array(c) for c in cols], names=["k", "w", "t1", "t2", "pos"])

    return phrases.mapInArrow(run, "k long, w long, t1 long, t2 long, pos int")


def merged(whole: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by windows that start in the (first, last) intervals."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(whole):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi + length))
        else:
            out.append((lo, hi + length))
    return out


def _spans(docs: DataFrame, length: int, gram: int | None, group_rows: int) -> DataFrame:
    """Per distinct data of docs (t1, t2, data) with repeated bytes: t1, t2, data, spans (array of struct<a int, b int>, byte runs)."""
    gram = length // 4 if gram is None else gram
    if not 0 < gram < length:
        raise ValueError("gram must be shorter than length")
    small_batches(docs.sparkSession)
    docs = docs.where(F.octet_length("data") >= length)
    occ = durable(_occurrences(docs, length, gram), "phrases")
    # A table of its own: the join with it can split frequent triggers, which it could not with the aggregate on one side.
    again = durable(occ.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("k"), "triggers")
    occ, old = durable(occ.join(again, "k"), "repeated-triggers"), occ
    release(old)
    release(again)
    one = F.struct("t1", "t2", "lo", "hi", "off")
    dictionary = durable(occ.groupBy("k", "f").agg(F.count(F.lit(1)).alias("n"), F.min(one).alias("at")), "dictionary")
    several = dictionary.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("k", (F.col("c") > group_rows).alias("hot"))
    opened = dictionary.join(several, "k").select("at.*", "n", "k", "hot")
    whole = occ.join(dictionary.where("n > 1").select("k", "f"), ["k", "f"]).select("t1", "t2", "lo", "hi")
    whole = whole.distinct().groupBy("t1", "t2").agg(F.collect_list(F.struct("lo", "hi")).alias("whole"))
    opened = opened.groupBy("t1", "t2").agg(F.collect_list(F.struct("k", "lo", "hi", "off", "n", "hot")).alias("open"))
    work = durable(whole.join(opened, ["t1", "t2"], "full"), "passages")
    release(occ)
    release(dictionary)
    texts = docs.groupBy("t1", "t2").agg(F.first("data").alias("data"))
    cand = durable(work.join(texts, ["t1", "t2"]), "candidates")
    release(work)
    asked = cand.where("open is not null")
    temps = [cand, durable(_matched(_phrases(asked, length, False), length), "matched")]
    starts = temps[1]
    if not asked.where(F.exists("open", lambda s: s["hot"])).isEmpty():
        win = durable(_windows(_phrases(asked, length, True), length), "windows")
        temps.append(win)
        twice = win.groupBy("k", "w").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("k", "w")
        starts = starts.unionByName(win.join(twice, ["k", "w"]).select("t1", "t2", F.col("pos").alias("a"), F.col("pos").alias("b")))
    starts = starts.groupBy("t1", "t2").agg(F.collect_list(F.struct("a", "b")).alias("starts"))
    found = cand.select("t1", "t2", "data", "whole").join(starts, ["t1", "t2"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        for batch in batches:
            spans = []
            for intervals, more in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                runs = merged([(x["lo"], x["hi"]) for x in intervals or []] + [(x["a"], x["b"]) for x in more or []], length)
                spans.append([{"a": a, "b": b} for a, b in runs])
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(spans, kind)], names=["t1", "t2", "data", "spans"])

    out = durable(found.mapInArrow(run, "t1 long, t2 long, data binary, spans array<struct<a:int,b:int>>").where(F.size("spans") > 0), "spans")
    for temp in temps:
        release(temp)
    return out


def _keyed(data: Column) -> list[Column]:
    """128 bits that stand for bytes, and the bytes; null counts as empty."""
    body = F.coalesce(data.cast("binary"), F.lit(bytearray()))
    return [F.xxhash64(body).alias("t1"), F.xxhash64(F.lit(7), body).alias("t2"), body.alias("data")]


def repeated_spans(df: DataFrame, text: str = "text", length: int = LENGTH, gram: int | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Per distinct text with repeated bytes: t1, t2 (its key), data (its bytes), spans (array of struct<a int, b int>, byte runs)."""
    return _spans(df.select(*_keyed(F.col(text).cast("string"))), length, gram, group_rows)


def narrowed(df: DataFrame, passages: DataFrame, text: str = "text", length: int = LENGTH, gram: int | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """passages (``repeated_spans`` of a shorter length over df) with column spans_long: the spans of ``length``."""
    many = df.select(*_keyed(F.col(text).cast("string"))[:2]).groupBy("t1", "t2").agg(F.least(F.count(F.lit(1)), F.lit(2)).cast("int").alias("n"))
    parts = passages.select("t1", "t2", "data", F.explode("spans").alias("s")).where(F.col("s.b") - F.col("s.a") >= length)
    parts = parts.select("t1", "t2", "s.a", F.substring("data", F.col("s.a") + 1, F.col("s.b") - F.col("s.a")).alias("data"))
    parts = parts.join(many, ["t1", "t2"])
    key = _keyed(F.col("data"))
    again = parts.select(*key, F.explode(F.array_repeat(F.lit(0), F.col("n")))).select("t1", "t2", "data")
    inner = _spans(again, length, gram, group_rows)
    placed = parts.select(F.col("t1").alias("d1"), F.col("t2").alias("d2"), "a", *key[:2]).join(inner.select("t1", "t2", "spans"), ["t1", "t2"])
    shifted = F.transform("spans", lambda s: F.struct((s["a"] + F.col("a")).alias("a"), (s["b"] + F.col("a")).alias("b")))
    placed = placed.select(F.col("d1").alias("t1"), F.col("d2").alias("t2"), shifted.alias("s"))
    placed = placed.groupBy("t1", "t2").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("spans_long"))
    out = durable(passages.join(placed, ["t1", "t2"], "left"), "spans-long")
    release(inner)
    return out


def _digest(data: bytes, spans: list[dict]) -> tuple[int, int, str]:
    at, kept, removed = 0, hashlib.sha256(), 0
    for s in spans:
        kept.update(data[at : s["a"]])
        removed += s["b"] - s["a"]
        at = s["b"]
    kept.update(data[at:])
    return removed, len(spans), kept.hexdigest()


def dedup_digest(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int | None = None, group_rows: int = GROUP_ROWS, passage: int | None = None) -> DataFrame:
    """Per row: the key, n_bytes, n_removed, n_spans, kept_sha256. With passage (at most length, in bytes) also
    n_passage_bytes and n_passages: the bytes and runs covered by strings of that length that start elsewhere too."""
    if passage is not None and passage > length:
        raise ValueError("passage must not be longer than length")
    spans = repeated_spans(df, text, length if passage is None else passage, gram, group_rows)
    if passage is not None:
        spans, short = narrowed(df, spans, text, length, gram, group_rows), spans
        release(short)
    held = spans.select("t1", "t2", "data", F.col("spans" if passage is None else "spans_long"))
    sizes = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_digest(t, s or []) for t, s in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.string())], names=["t1", "t2", "r", "s", "h"])

    cut = held.mapInArrow(run, "t1 long, t2 long, r long, s long, h string")
    if passage is not None:
        cut = cut.join(spans.select("t1", "t2", sizes.alias("pr"), F.size("spans").cast("long").alias("ps")), ["t1", "t2"])
    cut, old = durable(cut, "cut"), spans
    release(old)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    t1, t2, _ = _keyed(F.col(text).cast("string"))
    rows = df.select(F.col(key).alias("own"), t1, t2, F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body.cast("binary"), 256).alias("sha"))
    zero = lambda c, to: F.coalesce(c, F.lit(0).cast("long")).alias(to)
    out = rows.join(cut, ["t1", "t2"], "left")
    more = [] if passage is None else [zero("pr", "n_passage_bytes"), zero("ps", "n_passages")]
    return out.select(F.col("own").alias(key), "n_bytes", zero("r", "n_removed"), zero("s", "n_spans"), F.coalesce("h", "sha").alias("kept_sha256"), *more)


def kept_text(text: str, spans: list[dict]) -> str:
    """The text without its runs; characters that a run cuts are kept whole."""
    data, at, out = text.encode(), 0, []
    for s in spans:
        a, b = s["a"], s["b"]
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        out.append(data[at:a])
        at = max(a, b)
    out.append(data[at:])
    return b"".join(out).decode()


def dedup(df: DataFrame, text: str = "text", length: int = LENGTH, gram: int | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """df with repeated passages cut from the text (whole characters); n_chars, where there, follows. All columns of df may have any names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [kept_text(t, s) for t, s in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(got, pa.string())], names=["t1", "t2", "kept"])

    spans = repeated_spans(df, text, length, gram, group_rows)
    cut = durable(spans.select("t1", "t2", F.col("data").cast("string"), "spans").mapInArrow(run, "t1 long, t2 long, kept string"), "cut")
    release(spans)
    t1, t2, _ = _keyed(F.col(text).cast("string"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), t1, t2).join(cut, ["t1", "t2"], "left")
    own = {text: F.coalesce("kept", F.col("row")[text]).alias(text)}
    if "n_chars" in df.columns and df.schema["n_chars"].dataType in (T.LongType(), T.IntegerType()):
        own["n_chars"] = F.when(F.col("kept").isNull(), F.col("row")["n_chars"]).otherwise(F.length("kept")).cast(df.schema["n_chars"].dataType).alias("n_chars")
    return rows.select(*[own.get(c, F.col("row")[c].alias(c)) for c in df.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for 400 bytes; n_passage_bytes and n_passages for passages of 250, as the pipeline cuts them."""
    return dedup_digest(table(spark, sf_dir, "documents").select("doc_id", "text"), passage=PASSAGE)
