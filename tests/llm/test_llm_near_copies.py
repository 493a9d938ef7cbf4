"""The pipeline's near-copy stage against brute force over all pairs."""

import random

import pytest

import corpus_pipeline
from tidemark.llm import near_copies


def brute_kept(rows, words=5):
    """Least id of every component of Jaccard >= 0.8 over sets of word shingles."""
    sets = []
    for _, t in rows:
        p = (t or "").encode().lower().split()
        sets.append(frozenset(b" ".join(p[i : i + words]) for i in range(max(1, len(p) - words + 1))) if p else frozenset())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    return sorted(min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root))


def planted():
    """Texts with 0 to 12 words changed, in chains too, a line that many share, short texts, empty ones and copies."""
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(4000)]
    line = " ".join(r.choices(vocabulary, k=30))
    texts = [None, "", " ", "a b", "A  b", "a b c", "a b c d e", "a b c d e f"]
    for n in (20, 60, 150, 400, 3000):
        for _ in range(6):
            base = r.choices(vocabulary, k=n)
            texts.append(" ".join(base))
            at = base
            for k in (0, 1, 2, 3, 4, 8, 12):
                at = list(at if r.random() < 0.5 else base)
                for p in r.sample(range(n), k):
                    at[p] = r.choice(vocabulary)
                texts.append(" ".join(at) + r.choice(["", "", " " + line]))
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("group", [near_copies.GROUP, 500])
def test_planted_near_copies(spark, group):
    rows = planted()
    want = brute_kept(rows)
    assert len(want) < len({t for _, t in rows}) - 20
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(x.doc_id for x in near_copies.keep_one(df, group=group).collect()) == want
    assert near_copies.keep_one(df.limit(0)).count() == 0


def test_stage_drops_all_near_copies(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute_kept([(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()])
    out = dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, docs, sf)
    assert out.columns == docs.columns and sorted(x.doc_id for x in out.collect()) == want
