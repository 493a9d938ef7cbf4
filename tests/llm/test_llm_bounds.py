"""Bounds, methods and edge cases of the training-data operators against plain computations."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_llm_operators import DOCS, brute_components, brute_repeats, by_row, corpus, prose
from tidemark.llm import chat_format, decontaminate, packing, sharding, simhash, suffix_dedup, toxicity, url_filter


def best_fit_decreasing(sizes, capacity):
    owner = np.zeros(len(sizes), np.int64)
    packing.best_fit(np.argsort(-sizes, kind="stable"), sizes, capacity, [], owner, 0)
    return len(np.unique(owner))


@pytest.mark.parametrize("n,seed", [(300, 0), (1000, 1), (4000, 2), (12000, 3)])
def test_crossover_reaches_best_fit_decreasing(n, seed):
    """The yardstick is no seed of the first generation; crossovers bring the solutions to it or below."""
    r = np.random.default_rng(seed)
    sizes = np.clip(r.lognormal(6.3, 0.9, n).astype(np.int64), 1, 2047)
    first = packing.evolve(sizes, 2048, seed, 0, [])[0]
    known, done, gains = [], 0, 0
    for epoch in range(2):
        best, more, won = packing.evolve(sizes, 2048, seed + epoch, packing.CHILDREN, known)
        known, done, gains = [best], done + more, gains + won
    used = len(np.unique(best))
    assert np.bincount(best, sizes).max() <= 2048
    assert used <= best_fit_decreasing(sizes, 2048) and used <= len(np.unique(first))
    assert done >= 2 and (gains >= 1 or len(np.unique(first)) <= -(-int(sizes.sum()) // 2048))


def test_crossover_keeps_every_item():
    r = np.random.default_rng(1)
    for n in (1, 2, 5, 200):
        sizes = r.integers(1, 2048, n)
        a, b = packing.evolve(sizes, 2048, 1, 0, [])[0], packing.evolve(sizes, 2048, 2, 0, [])[0]
        for _ in range(20):
            child = packing.crossover(a, b, sizes, 2048, r)
            assert len(child) == n and np.bincount(child, sizes).max() <= 2048
            a, b = b, child


def test_shards_are_recomputed(spark):
    """Every shard from MD5 and logarithms by hand, with weights, null ids and many equal rows."""
    rows = [(i % 700 if i % 50 else None, f"text {i % 13}") for i in range(1500)] + [(5, "hot")] * 900 + [(5, None)]
    weights = [1.0, 2.0, 0.5, 1.0]

    def shard(key, weights):
        cost = [-math.log((int(hashlib.md5(f"{key}:{i}".encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)) / w for i, w in enumerate(weights)]
        return cost.index(min(cost))

    got = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), weights).collect()
    want = Counter()
    for key, t in rows:
        name, body = "null" if key is None else str(key), (t or "").encode()
        want[(key, len(body) + 8, zlib.crc32(body), shard(name, weights), shard(name, [*weights, 1.0]))] += 1
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_cells_of_any_size_without_gathering(spark, distance):
    """All cells over the bound: the meeting points find every link."""
    r = random.Random(distance)
    base = r.getrandbits(64)
    prints = {base}
    for _ in range(150):  # many within 24 bits of one another
        p = base
        for _ in range(r.randint(1, 7)):
            p ^= 1 << r.randrange(24)
        prints.add(p)
    prints |= {r.getrandbits(64) for _ in range(30)}
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long").repartition(3)
    found = simhash.links(df, distance, cell_rows=1).collect()
    assert all(((x.a ^ x.b) % (1 << 64)).bit_count() <= distance for x in found)
    root = {p: p for p in prints}
    for x in found:
        a, b = root[x.a % (1 << 64)], root[x.b % (1 << 64)]
        root = {k: a if v == b else v for k, v in root.items()}
    want = brute_components(prints, distance)
    assert {frozenset(k for k in prints if root[k] == v) for v in root.values()} == {frozenset(k for k in prints if want[k] == v) for v in want.values()}


@pytest.mark.parametrize("at_once", [0, 40, 1 << 20])
def test_components_by_rounds_and_at_once(spark, at_once):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, x) for x in range(2001, 2040)]
    edges = [e for e in edges if e[0] != e[1]]
    up = {x: x for e in edges for x in e}
    for a, b in edges:
        ra, rb = up[a], up[b]
        up = {k: ra if v == rb else v for k, v in up.items()}
    got = {x.node: x.root for x in simhash.components(spark.createDataFrame(edges, "a long, b long"), at_once).collect()}
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert groups(got) == groups(up)
    assert simhash.components(spark.createDataFrame([], "a long, b long"), at_once).count() == 0


@pytest.mark.parametrize("group", [10_000, 2])
def test_two_lengths(spark, group):
    """Spans of 120 bytes and, within them, those of 400: both as brute force has them."""
    one, two = prose(40, 5), prose(90, 6)
    rows = corpus() + [(100 + i, prose(15, 700 + i) + one + prose(15, 800 + i), "en", "s", 1) for i in range(6)] + [(200 + i, two[i:] + str(i) + one, "en", "s", 1) for i in range(4)]
    texts = [(r[1] or "").encode() for r in rows]
    want = Counter((r[0], *long, *short[1:3]) for r, long, short in zip(rows, brute_repeats(texts, 400), brute_repeats(texts, 120), strict=True))
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    assert by_row(suffix_dedup.dedup_digest(df, passage=120, group_rows=group)) == want
    assert suffix_dedup.dedup_digest(df.limit(0), passage=120).count() == 0


def test_suffix_arrays_of_many_triggers():
    """Runs of starts from both arrays against all pairs, several triggers at once."""
    r = random.Random(4)
    text = bytes(r.choices(b"ab", k=4000))
    length, phrases, group = 24, [], []
    for g in range(6):
        seen = set()
        for _ in range(r.choice([1, 2, 9, 30])):
            at = r.randrange(0, 3900)
            off = r.randrange(0, 20)
            p = text[at : at + off + length + r.randrange(0, 8)]
            if (p[off:], p[:off]) not in seen and len(p) - length <= off:
                seen.add((p[off:], p[:off]))
                phrases.append((p, off))
                group.append(g)
    who, a, b = suffix_dedup.repeated_starts(np.array(group), phrases, length)
    got = {(i, s) for i, x, y in zip(who.tolist(), a.tolist(), b.tolist()) for s in range(x, y + 1)}
    windows = defaultdict(set)
    for i, (p, off) in enumerate(phrases):
        for s in range(max(0, 0), len(p) - length + 1):
            if s <= off:
                windows[(group[i], off - s, p[s : s + length])].add((i, s))
    assert got == {x for v in windows.values() if len({i for i, _ in v}) > 1 for x in v}


def test_own_column_names_are_free(spark):
    rows = [(r[0], r[1], 1, 2, "k", "r") for r in corpus()]
    df = spark.createDataFrame(rows, "doc_id long, text string, t1 int, t2 int, kept string, row string")
    out = suffix_dedup.dedup(df, length=120)
    assert out.columns == df.columns and out.count() == len(rows)
    assert {(r.t1, r.t2, r.kept, r.row) for r in out.collect()} == {(1, 2, "k", "r")}


def test_filter_in_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "CHUNK_WORDS", 4)
    universe = spark.range(4000).select(F.col("id").cast("string").alias("key"))
    listed = universe.where("key % 7 = 0")
    c = url_filter.Cascade(listed, universe)
    assert len(c.levels[0].bits) > 4 * 8 * 3
    assert universe.where(c.has(F.col("key"))).exceptAll(listed).isEmpty() and listed.where(~c.has(F.col("key"))).isEmpty()


def test_urls_and_chats_of_any_length(spark):
    url = "http://www.example.com/en/" + "a/" * 300_000 + "?" + "q" * 100_000
    r = url_filter.filter_urls(spark.createDataFrame([(1, url)], "page_id long, url string")).first()
    assert (r.host, len(r.path), r.rule, r.verdict) == ("www.example.com", 4 + 600_000, "www.example.com/en/", "allow")
    said = "[INST] </s> " * 60_000
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 2, "user", None), (1, 3, "assistant", "")]
    d = chat_format.digest(chat_format.expand(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert d.n_turns == 4 and d.loss_chars == len(said) and d.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert d.turns_sha256 == hashlib.sha256("".join(f"{x[2]}\n{x[3] or ''}\n" for x in rows).encode()).hexdigest()


def test_windows_of_a_text_with_many_places(spark):
    """A text where every word is a prefix word: places carry their surroundings only."""
    item = " ".join(f"w{i}" for i in range(10))
    text = " ".join(["w0"] * 20_000 + item.split() + ["w0"] * 5)
    docs = spark.createDataFrame([(1, text), (2, "w0 w1"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: (20_015, 10, 1), 2: (2, 0, 0), 3: (0, 0, 0)}


def test_ftrl_equals_the_formula():
    """The vectorised learner against the update rule written out for one coordinate at a time."""
    p = toxicity.Params(bits=6, l1=0.3, l2=0.1, alpha=0.5, beta=1.0)
    r = random.Random(6)
    model, z, n = toxicity.Ftrl(p), defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= p.l1:
            return 0.0
        return -(z[i] - math.copysign(p.l1, z[i])) / ((p.beta + math.sqrt(n[i])) / p.alpha + p.l2)

    for _ in range(300):
        at, label = sorted(r.sample(range(64), 5)), r.randint(0, 1)
        model.learn(np.array(at), label)
        w = {i: weight(i) for i in [*at, 64]}
        g = 1 / (1 + math.exp(-sum(w.values()))) - label
        for i, x in w.items():
            s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / p.alpha
            z[i] += g - s * x
            n[i] += g * g
    assert np.allclose(model.weights(np.arange(65)), [weight(i) for i in range(65)])


def test_features_of_a_text_over_a_slice():
    """A text cut into slices has the features of the whole text."""
    text = prose(120_000, 9)
    assert len(text.encode()) > toxicity._SLICE
    whole = np.unique(np.concatenate([f for _, f in toxicity.features([text], 40)]))
    words = np.concatenate([toxicity.word_hashes(np.frombuffer(text.encode()[a:b], np.uint8))[1] for a, b in [(0, len(text.encode()))]])
    mix, shift = toxicity._mix, np.uint64(24)
    one = mix(words) >> shift
    two = mix(words[:-1] * np.uint64(3) + words[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> shift
    skip = mix(words[:-2] * np.uint64(5) + words[2:] * np.uint64(0x165667B19E3779F9)) >> shift
    assert np.array_equal(whole, np.unique(np.concatenate((one, two, skip)).astype(np.int64)))


def test_pipeline_of_odd_tables(spark, sf, tmp_path):
    """An empty table, and null texts, ids and repeated rows, through every stage."""
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (None, "no id", "en", "s", 5), (2, "", "en", "s", 0), (3, prose(200, 1), "en", "s", 1), (3, prose(200, 1), "en", "s", 1), (4, prose(200, 1), "en", "s", 1), (5, prose(50, 2), None, None, 3)]
    for df, left in ((spark.createDataFrame([], kinds), 0), (spark.createDataFrame(rows, kinds), 4)):
        df.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()
        assert len(got) == left, got
