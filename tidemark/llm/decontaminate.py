"""Operator 9: benchmark decontamination by a prefix-filtered set join, native expressions only.

Every item gives its windows of ``size`` consecutive words (an item with fewer words: one window). A document
contains a window only if it contains all its words, so the prefix of the join is a single word
(length - required overlap + 1 = 1): the word of the window that is rarest in the corpus. Documents are joined
by that word alone; length and positional bounds (the window must fit around the word's place) cut
candidates, and comparing the words verifies each. Words that are no prefix are passed over inside their row;
only the places of prefix words meet the broadcast windows, and only verified places are shuffled.

The broadcast holds about ``windows_at_once`` windows and BYTES_AT_ONCE bytes of words at most; a larger benchmark is
joined in parts of that size, each with a pass over the documents. A word's rarity is counted over all documents.

Defined results: null texts and ids: no words, null ids form no item; a document without hits has zeros, the digest of the empty string
and false; repeated documents are answered one by one, repeated items count by their item_id; an empty
benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ascii_lower, durable, table

SIZE = 10
WINDOWS_AT_ONCE, BYTES_AT_ONCE = 20_000, 32 << 20
#: What stands between words of lower-cased text.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def _windows(benchmark: DataFrame, item: str, text: str, size: int) -> DataFrame:
    """Distinct windows (words) with the items that hold them."""
    w = benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("item"), words(F.col(text).cast("string")).alias("w")).where("size(w) > 0")
    cut = w.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1))), lambda i: F.slice("w", i, size))).alias("window"))
    return cut.groupBy("window").agg(F.collect_set("item").alias("items"))


def _among(words_of: DataFrame):
    """Whether a word is one of the column __word, at most windows_at_once x size words."""
    held = [r[0] for r in words_of.select("__word").distinct().collect()]
    return lambda x: x.isin(held) if held else F.lit(False)


def hits(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = SIZE, windows_at_once: int = WINDOWS_AT_ONCE) -> DataFrame:
    """Per row of df: __key, __t (hash of the text), n_words, n_hit, n_items, items_sha256, contaminated; equal rows once, with __rows of them."""
    windows = durable(_windows(benchmark, item, item_text, size).withColumn("id", F.monotonically_increasing_id()), "windows")
    n, held = windows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.array_join("window", " "))), F.lit(0))).first()
    parts = max(1, -(-n // windows_at_once), -(-held // BYTES_AT_ONCE))
    docs = df.select(F.col(key).alias("__key"), F.xxhash64(F.col(text).cast("string")).alias("__t"), F.octet_length(F.col(text).cast("string")).alias("__len"), words(F.col(text).cast("string")).alias("__w"))
    found = None
    for part in range(parts):
        mine = windows.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == part) if parts > 1 else windows
        vocabulary = mine.select(F.explode("window").alias("__word")).distinct()
        among = _among(vocabulary)
        seen = docs.select(F.explode(F.filter("__w", among)).alias("__word")).groupBy("__word").agg(F.count(F.lit(1)).alias("c"))
        rarity = vocabulary.join(seen, "__word", "left").select("__word", F.coalesce("c", F.lit(0)).alias("c"))
        ranked = mine.select("id", "window", F.posexplode("window").alias("o", "__word")).join(rarity, "__word")
        prefix = ranked.groupBy("id").agg(F.min(F.struct("c", "__word", "o")).alias("m"), F.first("window").alias("window"))
        prefix = prefix.select(F.col("m.__word").alias("__word"), F.col("m.o").alias("o"), "id", "window")
        # One row a word: a place meets its windows as one array.
        prefix = prefix.groupBy("__word").agg(F.collect_list(F.struct("o", "id", "window")).alias("by"))
        prefix = durable(prefix, "prefixes")
        among = _among(prefix)
        # A place takes the words around it along, not the document's: a window around it lies within them.
        base = lambda p: F.greatest(p - (size - 1), F.lit(1))
        places = F.array_compact(F.transform("__w", lambda x, i: F.when(among(x), F.struct((i + 1).alias("p"), x.alias("word"), F.slice("__w", base(i + 1), 2 * size - 1).alias("near")))))
        if part == 0:  # place 0 stands for the document itself, so that documents without hits come through the same pass
            self = F.struct(F.lit(0).alias("p"), F.lit("").alias("word"), F.array().cast("array<string>").alias("near"))
            places = F.array_insert(places, 1, self)
            prefix = prefix.unionByName(df.sparkSession.range(1).select(F.lit("").alias("__word"), F.array().cast(prefix.schema["by"].dataType).alias("by")))
        at = lambda x: F.col("__p.p") - x["o"]  # noqa: E731  first word of the window, from 1
        fits = lambda x: (at(x) >= 1) & (at(x) + F.size(x["window"]) - 1 <= F.col("__n"))
        same = lambda x: F.slice("__p.near", at(x) - base(F.col("__p.p")) + 1, F.size(x["window"])) == x["window"]
        near = docs.select("__key", "__t", "__len", F.size("__w").alias("__n"), F.explode(places).alias("__p")).withColumn("__word", F.col("__p.word"))
        near = near.join(F.broadcast(prefix), "__word")
        ok = F.transform(F.filter("by", lambda x: fits(x) & same(x)), lambda x: F.struct(at(x).alias("a"), (at(x) + F.size(x["window"])).alias("b"), x["id"].alias("id")))
        near = near.select("__key", "__t", "__len", F.col("__n").alias("n"), (F.col("__p.p") == 0).alias("self"), ok.alias("ok")).where("self or size(ok) > 0")
        near = durable(near, "part") if parts > 1 else near
        found = near if found is None else found.unionByName(near)
    flat = found.select("__key", "__t", "__len", "n", "self", F.explode_outer("ok").alias("x"))
    # Equal places of a row merge before the shuffle of whole rows.
    grouped = flat.groupBy("__key", "__t", "__len").agg(F.max("n").alias("n_words"), F.count_if("self").alias("__rows"), F.collect_set(F.when(F.col("x").isNotNull(), F.struct(F.col("x.a").alias("a"), F.col("x.b").alias("b")))).alias("spans"), F.collect_set("x.id").alias("ids"))
    union = F.aggregate(F.array_sort("spans"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
                        lambda s, x: F.struct((s["n"] + F.greatest(x["b"] - F.greatest(x["a"], s["end"]), F.lit(0))).alias("n"), F.greatest(s["end"], x["b"]).alias("end")))["n"]
    grouped = durable(grouped.select("__key", "__t", "__len", "n_words", "__rows", union.alias("n_hit"), "ids"), "hits")
    named = grouped.where("size(ids) > 0").select("__key", "__t", "__len", F.explode("ids").alias("id")).join(windows.select("id", "items"), "id")
    named = named.select("__key", "__t", "__len", F.explode("items").alias("item")).groupBy("__key", "__t", "__len").agg(F.array_sort(F.collect_set("item")).alias("items"))
    same_row = [F.col(f"g.{c}").eqNullSafe(F.col(f"m.{c}")) for c in ("__key", "__t", "__len")]
    out = grouped.alias("g").join(named.alias("m"), same_row[0] & same_row[1] & same_row[2], "left")
    items = F.coalesce("m.items", F.array().cast("array<string>"))
    return out.select("g.__key", "g.__t", "g.__len", "__rows", F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
                      F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def contamination(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """Per row: the key, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = hits(df, benchmark, key, **options)
    rows = found.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__rows"))))
    return rows.select(F.col("__key").alias(key), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def drop_contaminated(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of df that hold no window of the benchmark."""
    bad = hits(df, benchmark, key, text, **options).where("contaminated").select("__key", "__t", "__len")
    body = F.col(text).cast("string")
    return df.join(bad, F.col(key).eqNullSafe(F.col("__key")) & F.xxhash64(body).eqNullSafe(F.col("__t")) & F.octet_length(body).eqNullSafe(F.col("__len")), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, w[i : least(i + 9, len(w))] AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM bw),
dw AS (
  SELECT r, i, i + n AS e, w[i : i + n - 1] AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT dw.r, dw.i, dw.e, bw.item FROM dw JOIN bw ON dw.win = bw.win),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, e)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.r = pos.r LEFT JOIN its ON d.r = its.r
"""
