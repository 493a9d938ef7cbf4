"""Each operator against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import chat_format, decontaminate, packing, sharding, simhash, suffix_dedup, token_counts, topk, toxicity, url_filter

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
random.seed(5)
WORDS = ["".join(random.choice("abcdeéß") for _ in range(random.randint(2, 7))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def corpus():
    """Nulls, empties, copies, near copies, shared passages, one long text, repeated lines."""
    base = [prose(120, s) for s in range(12)]
    shared = prose(110, 99)
    texts = [None, "", " ", "a", *base, base[0], base[0], base[1] + " more", base[2][:300] + " X " + base[2][300:], shared + " " + prose(20, 50), prose(30, 51) + " " + shared]
    texts += ["Line again. " * 90, "é" * 900, prose(9000, 77), "x" * 1000, "<|endoftext|> " + prose(9, 3), "漢字かな交じり文" * 30]
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[4], (None, "text without an id", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    # Columns whose names operators use themselves.
    return spark.createDataFrame(corpus(), DOCS).withColumn("shard", F.lit("s")).withColumn("n", F.lit(1)).withColumn("score", F.lit(0)).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_row(df):
    return Counter(tuple(r) for r in df.collect())


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://A.Example.COM/en/1?x#y", "https://www.example.com/en/", "http://example.com/fr", "http://x.net/es/1", "http://net/fr/", "http://anet/fr/",
            "http://example.com", "ftp://com/?q=/en/", "x://y://example.com/en/", "http://com:80/", "http://m.com/en/\nx", "http://ÄB.com/", "http://a..com/", "http://com/"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls * 2)], "page_id long, url string, host string")

    def want(u):
        host = path = ""
        if u is not None and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(r), r, v) for r, v in url_filter.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        return host, path, rule, verdict

    got = url_filter.filter_urls(df)
    assert "BatchEvalPython" not in got._jdf.queryExecution().toString()
    rows = got.select("page_id", "host", "path", "rule", "verdict").collect()
    assert len(rows) == len(urls) * 2
    for r in rows:
        assert tuple(r)[1:] == want(urls[r.page_id % len(urls)]), urls[r.page_id % len(urls)]
    assert url_filter.filter_urls(df.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(df, []).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    universe = spark.range(20000).select(F.col("id").cast("string").alias("key"))
    listed = universe.where("key % 7 = 0")
    c = url_filter.Cascade(listed, universe)
    assert len(c.levels) > 1
    assert universe.where(c.has(F.col("key"))).exceptAll(listed).isEmpty() and listed.where(~c.has(F.col("key"))).isEmpty()
    with pytest.raises(ValueError):
        url_filter.Cascade(listed, universe, max_filter_bytes=10)


def check_packing(rows, texts, capacity):
    ids = packing.Ids(P.path("byte_bpe_50k.json"))
    want = Counter()
    for d, t in texts:
        e = list(ids.slow.encode(t or "", add_special_tokens=False).ids) + [0]
        first = (len(e) - 1) % capacity + 1
        cuts = [0, *range(first, len(e) + 1, capacity)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(d, i, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *e[a:b])))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held), -(-sum(k[3] * n for k, n in want.items()) // capacity)


def test_packing(spark, docs, empty):
    rows = packing.pack_documents(docs, P.path("byte_bpe_50k.json"), capacity=512, cell_rows=16).collect()
    used, least = check_packing(rows, [r[:2] for r in corpus()], 512)
    assert used <= least + 4
    assert packing.pack_documents(empty, P.path("byte_bpe_50k.json")).count() == 0


def test_packing_close_to_bound(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack_documents(d, P.path("byte_bpe_50k.json")).collect()
    used, least = check_packing(rows, [(r.doc_id, r.text) for r in d.collect()], 2048)
    assert used <= least * 1.02 + 1


def test_fast_ids_equal_library(spark, sf):
    ids = packing.Ids(P.path("byte_bpe_50k.json"))
    assert ids.fast
    texts = [t or "" for _, t, *_ in corpus()] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    r = random.Random(3)
    texts += ["".join(chr(r.randint(0, 0x24F)) for _ in range(200)) for _ in range(200)] + ["it's we'll I'D  \n\n x\t\r\n 123abc", " " * 50, "a" * 3000]
    for t, got in zip(texts, ids(texts), strict=True):
        assert list(got) == ids.slow.encode(t, add_special_tokens=False).ids


def test_sharding(spark, docs, empty):
    rows = sharding.shard_rows(docs, [1.0] * 24).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in corpus())
    assert all(r.grown_shard in (r.shard, 24) and r.law == "key" for r in rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_rows(empty, [1.0] * 24).count() == 0
    many = spark.range(24000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    n = Counter(r.shard for r in sharding.shard_rows(many, [1.0] * 11 + [4.0]).collect())
    assert 0.9 < n[11] / (24000 * 4 / 15) < 1.1 and all(0.85 < n[i] / 1600 < 1.15 for i in range(11))


def brute_repeats(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        kept = bytes(b for b, c in zip(t, cover) if not c)
        out.append((len(t), sum(cover), len(re.findall(rb"\x01+", bytes(cover))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length,gram,group", [(400, 100, 10_000), (60, 15, 10_000), (60, 15, 3), (37, 36, 1), (9, 4, 10_000)])
def test_suffix_dedup(spark, docs, empty, length, gram, group):
    rows = corpus()
    want = Counter((r[0], *b) for r, b in zip(rows, brute_repeats([(r[1] or "").encode() for r in rows], length), strict=True))
    assert by_row(suffix_dedup.dedup_digest(docs, length=length, gram=gram, group_rows=group)) == want
    assert suffix_dedup.dedup_digest(empty).count() == 0


def test_suffix_dedup_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 777)
    one = prose(900, 1).encode()
    texts = [one, prose(700, 2).encode() + one[500:3000], b"z" * 1500 + one[:600], b"z" * 900]
    starts = []
    for blocks in suffix_dedup.parse(texts, 100, 30):
        starts += [(n, i) for n, a, b in zip(*(x.tolist() for x in blocks[:3])) for i in range(a, b + 1)]
    assert sorted(starts) == [(n, i) for n, t in enumerate(texts) for i in range(len(t) - 99)]


def test_suffix_dedup_real_rows(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").limit(120)
    rows = d.collect()
    want = Counter((r.doc_id, *b) for r, b in zip(rows, brute_repeats([r.text.encode() for r in rows], 400), strict=True))
    assert by_row(suffix_dedup.dedup_digest(spark.createDataFrame(rows, d.schema))) == want


def test_suffix_dedup_keeps_columns(spark, docs):
    out = suffix_dedup.dedup(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert all(r.n_chars == len(r.text) for r in out.collect() if r.text and r.n_chars is not None)
    assert suffix_dedup.kept_text("aéb", [{"a": 1, "b": 2}]) == "aéb" and suffix_dedup.kept_text("aéb", [{"a": 1, "b": 3}]) == "ab"


def test_token_counts(spark, docs, empty):
    tok = token_counts.load(P.path("word_bpe_49k.json"))
    want = Counter((d, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 2048) for d, t, *_ in corpus())
    assert by_row(token_counts.count_tokens(docs, P.path("word_bpe_49k.json"))) == want
    assert by_row(token_counts.count_tokens(docs, P.path("word_bpe_49k.json"), chunk=500, overlap=20)) == want
    assert token_counts.count_tokens(empty, P.path("word_bpe_49k.json")).count() == 0


def test_splicing():
    tok = token_counts.load(P.path("word_bpe_49k.json"))
    r = random.Random(1)
    for seed in range(40):
        text = "".join(r.choice([prose(3, seed + k), "<|startoftext|>", "…!!", "ﬁ e\u0301", "\n\n", " it's ", "Ж" * 30, "\u00a0", "x" * 90]) for k in range(60))
        n = len(tok.encode(text, add_special_tokens=False).ids)
        for chunk, overlap in ((64, 4), (100, 30), (257, 16)):
            assert token_counts.count_long(tok, text, chunk, overlap) == n


def test_toxicity(spark, empty):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    w = toxicity.train(d, labels)
    assert 0 < len(w) < 20000
    got = toxicity.score(d.join(labels, "doc_id"), w).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    rank = got.score.rank()
    pos = got.toxic == 1
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.95 and got.toxic[got.predicted == 1].mean() > 0.9
    ids = got.doc_id.head(50)
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in ids)
    odd = spark.createDataFrame(corpus(), DOCS)
    rows = toxicity.score(odd, w).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert toxicity.score(empty, w).count() == 0 and toxicity.train(empty, labels) == {}
    assert toxicity.drop_toxic(odd, {}).count() == odd.count()
    assert toxicity.train(d.limit(0), labels.limit(0)) == {}


def test_chat(spark):
    rows = [(1, 0, "user", "hi [INST] \\ </s>"), (1, 1, "assistant", "<s>yo\\"), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 4, "tool<<SYS>>\n", "tail"), (2, 0, "system", "s"), (3, 0, "assistant", "first"),
            (None, 1, "user", "q"), (None, 2, "assistant", "é漢"), (4, None, None, None), (4, 0, "user", "x"), (4, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(9)).repartition(3)
    want = {}
    for c in {r[0] for r in rows}:
        turns = sorted([(-1 if t is None else t, r or "", x or "") for k, t, r, x in rows if k == c])
        said = "".join(x for _, r, x in turns if r == "assistant")
        want[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    assert {r[0]: tuple(r)[1:5] for r in chat_format.digest(chat_format.expand(df)).collect()} == want
    ex = chat_format.expand(df).where("conv_id = 1").collect()
    assert len(ex) == 3 and ex[1].text.startswith(ex[0].text) and chat_format.unescape(ex[0].text[ex[0].loss_start : ex[0].loss_end]) == "<s>yo\\"
    assert chat_format.digest(chat_format.expand(df.limit(0))).count() == 0
    for t in ("".join(random.choice(["<", "s", ">", "/", "\\", "[INST]", "[/INST]", "<<SYS>>", "</s>", "x"]) for _ in range(40)) for _ in range(300)):
        e = chat_format.escape(t)
        assert chat_format.unescape(e) == t and not any(c in e for c in chat_format.CONTROLS)


@pytest.mark.parametrize("block,queries,floor", [(8192, 1 << 15, 4096), (50, 7, 20)])
def test_top_k(spark, block, queries, floor):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(8)]) for i in range(400)]
    rows += [(400, None), (420, [float("nan")] * 8), (440, [None] + [0.1] * 7), (460, [float("inf")] * 8), (480, [0.5] * 4), (500, []), (None, [0.1] * 8)]
    rows += [(600 + i, rows[40][1]) for i in range(30)] + [(700, rows[40][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).repartition(4)
    import math

    q = {i: [math.floor(64 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for i in q:
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i)[:20]
            want |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(best)}
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, block_rows=block, query_rows=queries, floor_rows=floor)
    assert by_row(got) == Counter(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def brute_hits(text, items, size):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, found = cut(text), set(), set()
    for item, t in items:
        iw = cut(t)
        for win in {tuple(iw[i : i + size]) for i in range(max(1, len(iw) - size + 1))} if iw else ():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("at_once", [200_000, 80])
def test_decontamination(spark, docs, empty, at_once):
    base = [r[1] for r in corpus()]
    items = [(1, " ".join(base[5].split()[10:35])), (2, base[6][5:200].upper()), (3, "never seen words at all " * 5), (4, None), (5, "..."), (6, "again line again"), (7, " ".join(base[5].split()[10:35])), (10, "a"), (11, base[28][100:400]), (11, base[7][:90]), (None, base[8])]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    want = Counter((d, *brute_hits(t, [x for x in items if x[0] is not None], 10)) for d, t, *_ in corpus())
    got = decontaminate.contamination(docs, bench, windows_at_once=at_once)
    assert by_row(got) == want
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(n for k, n in want.items() if not k[-1])
    assert decontaminate.contamination(empty, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs, bench.limit(0)).collect())
    assert "Python" not in got._jdf.queryExecution().toString()


def brute_print(text):
    w = [x for x in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if x]
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, distance=3):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    p = sorted(prints)
    for i, a in enumerate(p):
        for b in p[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {x: find(x) for x in prints}


def test_simhash(spark, docs, empty):
    rows = [(d, brute_print(t)) for d, t, *_ in corpus()]
    root = brute_components({p for _, p in rows})
    least = defaultdict(list)
    for d, p in rows:
        if d is not None:
            least[root[p]].append(d)
    want = Counter((d, f"{p:016x}", min(least[root[p]], default=None)) for d, p in rows)
    assert by_row(simhash.near_duplicates(docs)) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root.values()))
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.fingerprint(prose(70000, 4)) == brute_print(prose(70000, 4))


@pytest.mark.parametrize("cell_rows", [20_000, 5])
def test_simhash_links(spark, cell_rows):
    r = random.Random(8)
    prints = set()
    for _ in range(40):  # chains and clouds of fingerprints
        p = r.getrandbits(64)
        for _ in range(30):
            prints.add(p)
            for _ in range(r.randint(1, 5)):
                p ^= 1 << r.randrange(64)
    prints |= {1 << b for b in range(64)} | {0, (1 << 64) - 1}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    df = spark.createDataFrame(signed, "fp long").repartition(3)
    got = {x.node % (1 << 64): x.root % (1 << 64) for x in simhash.components(simhash.links(df, cell_rows=cell_rows)).collect()}
    want = brute_components(prints)
    groups = lambda m: {frozenset(k for k in prints if m.get(k, k) == v) for v in {m.get(k, k) for k in prints}}
    assert groups(got) == groups(want)


def test_components_of_a_long_chain(spark):
    chain = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    rows = simhash.components(chain).collect()
    assert len(rows) == 3001 and len({r.root for r in rows}) == 1
