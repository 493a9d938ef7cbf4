"""Operator 1: URL filters by a Bloom filter cascade, native expressions only.

Level 0 encodes the listed keys. Level 1 encodes the keys of the universe that pass level 0 without being
listed, level 2 the listed keys that pass level 1, and so on until a level lets nothing false through. A key
of the universe is listed if and only if the first level that lacks it is an odd one. The universe is every
key that any URL of the corpus can ask for, so the answers are exact, and no join is needed.

The first level is sized by |list| / universe as in cascades of revocation lists, so the later levels hold
about as many keys as the list, however large the corpus is. The cascade is broadcast as binary literals;
its size is checked against ``max_filter_bytes``.

Defined results: null URLs, and URLs without "://", have empty host and path and fit no rule; URLs that fit no
rule get ``default``. Repeated rows are judged one by one. Other columns are kept; output columns of the
same name are replaced. Rules that differ in their action only are refused.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import ascii_lower, durable, table

#: The contract's rules: (rule, verdict).
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))

#: 64-bit words of a filter that come to the driver as one row.
CHUNK_WORDS = 1024

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_path(url: Column) -> tuple[Column, Column]:
    part = lambda i: F.coalesce(F.regexp_extract(url, URL, i), F.lit(""))
    return ascii_lower(part(1)), part(2)


def _bits(key: Column, level: int, n_bits: int, k: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * 64 + i)), F.lit(n_bits)) for i in range(k)]


def _mask(at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(1 << b) for b in range(8)]), (F.pmod(at, F.lit(8)) + 1).cast("int"))


class Level:
    def __init__(self, number: int, bits: bytearray, n_bits: int, k: int):
        self.number, self.bits, self.n_bits, self.k = number, bits, n_bits, k

    def has(self, key: Column) -> Column:
        held = F.lit(self.bits)
        found = None
        for at in _bits(key, self.number, self.n_bits, self.k):
            byte = F.conv(F.hex(F.substring(held, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            one = byte.bitwiseAND(_mask(at)) != 0
            found = one if found is None else found & one
        return found


def _level(keys: DataFrame, number: int, n: int, rate: float, max_bytes: int) -> Level:
    """A filter of the keys (column ``key``), built by a distributed bit_or of its words."""
    n_bits = max(64, math.ceil(n * math.log2(1 / rate) / math.log(2)))
    n_bits = (n_bits + 63) // 64 * 64
    if n_bits // 8 > max_bytes:
        raise ValueError(f"the filter needs {n_bits // 8} bytes, more than max_filter_bytes={max_bytes}")
    k = max(1, round(math.log2(1 / rate)))
    at = keys.select(F.explode(F.array(*_bits(F.col("key"), number, n_bits, k))).alias("at"))
    # Words of 64 bits whose hex digits are the filter's bytes in order, then chunks of words: the driver gets a row a chunk.
    bit = F.expr("shiftleft(1L, cast(56 - 8 * (at % 64 div 8) + at % 8 as int))")
    words = at.groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(bit).alias("bits"))
    chunks = words.groupBy(F.expr(f"word div {CHUNK_WORDS}").alias("chunk")).agg(F.map_from_entries(F.collect_list(F.struct(F.expr(f"cast(word % {CHUNK_WORDS} as int)").alias("i"), F.lpad(F.hex("bits"), 16, "0").alias("x")))).alias("held"))
    whole = F.transform(F.sequence(F.lit(0), F.lit(CHUNK_WORDS - 1)), lambda i: F.coalesce(F.try_element_at("held", i), F.lit("0" * 16)))
    bits = bytearray(-(-n_bits // 64 // CHUNK_WORDS) * CHUNK_WORDS * 8)
    for chunk, data in chunks.select("chunk", F.unhex(F.array_join(whole, "")).alias("data")).collect():  # at most max_bytes in all
        bits[chunk * CHUNK_WORDS * 8 : (chunk + 1) * CHUNK_WORDS * 8] = data
    return Level(number, bits[: n_bits // 8], n_bits, k)


class Cascade:
    """Exact membership of ``listed`` for every key of ``universe`` (DataFrames with a column ``key``)."""

    def __init__(self, listed: DataFrame, universe: DataFrame, max_filter_bytes: int = 64 << 20):
        listed = listed.select("key").distinct()
        n = listed.count()
        size = universe.agg(F.approx_count_distinct("key")).first()[0]  # sizes the first level, exactness doesn't rest on it
        self.levels: list[Level] = []
        if not n:
            return
        rate = min(0.5, max(1e-9, n / (math.sqrt(2) * max(1, size))))
        first = _level(listed, 0, n, rate, max_filter_bytes)
        self.levels.append(first)
        # What passes level 0 is about as large as the list; only that is shuffled.
        passing = universe.select("key").where(first.has(F.col("key"))).withColumn("is", F.lit(0))
        keys = durable(passing.unionByName(listed.withColumn("is", F.lit(1))).groupBy("key").agg(F.max("is").alias("is")), "cascade")
        false = keys.where("is = 0")
        while n := false.count():
            level = _level(false, len(self.levels), n, 0.5, max_filter_bytes)
            self.levels.append(level)
            # The next level holds what passes every level so far and is of the other kind than the last level's keys.
            false = keys.where(f"is = {1 - len(self.levels) % 2}")
            for earlier in self.levels[1:]:
                false = false.where(earlier.has(F.col("key")))
            if len(self.levels) > 60:
                raise RuntimeError("the cascade does not end")

    def has(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            out = F.when(level.has(key), out).otherwise(F.lit(level.number % 2 == 1))
        return out


def filter_urls(df: DataFrame, rules: Iterable[tuple[str, str]] = RULES, url: str = "url", default: str = "allow", max_filter_bytes: int = 64 << 20) -> DataFrame:
    """Adds host, path, rule and verdict to every row. ``rules``: (host + path, "allow" or "block")."""
    rules = list(rules)
    spark = df.sparkSession
    if len({r for r, _ in rules}) != len({*rules}) or any("/" not in r or v not in ("allow", "block") for r, v in rules):
        raise ValueError("rules are host/path strings with one action, allow or block, each")
    labels = max([r.split("/")[0].count(".") + 1 for r, _ in rules], default=0)
    lengths = sorted({len(r) - r.index("/") for r, _ in rules}, reverse=True)
    host, path = host_path(F.col(url))
    names = ("host", "path", "rule", "verdict")
    keep = [F.col(f"`{c}`") for c in df.columns if c not in names]
    base = df.select(*keep, host.alias("host"), path.alias("path"))
    parts = F.split(F.col("host"), r"\.")
    hosts = [F.when(F.size(parts) >= k, F.array_join(F.slice(parts, -k, k), ".")) for k in range(labels, 0, -1)]
    paths = [F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]
    keys = F.array_compact(F.array(*[F.concat(h, p) for h in hosts for p in paths])) if rules else F.array().cast("array<string>")
    # Longest rule first; the key's own text breaks ties.
    keys = F.transform(F.sort_array(F.transform(keys, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))), asc=False), lambda x: x["key"])
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("block", T.BooleanType())])
    listed = spark.createDataFrame([(r, v == "block") for r, v in rules], schema)
    asked = base.select(F.explode(keys).alias("key"))
    is_rule = Cascade(listed, asked, max_filter_bytes)
    is_block = Cascade(listed.where("block"), listed, max_filter_bytes)
    out = base.withColumn("rule", F.try_element_at(F.filter(keys, is_rule.has), F.lit(1)))
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).when(is_block.has(F.col("rule")), F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumn("verdict", verdict)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages),
r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
n AS (SELECT row_number() OVER () AS n, * FROM u),
m AS (
  SELECT n.n, r.h || r.p AS rule, r.v, row_number() OVER (PARTITION BY n.n ORDER BY length(r.h || r.p) DESC) AS k
  FROM n JOIN r ON (n.host = r.h OR ends_with(n.host, '.' || r.h)) AND starts_with(n.path, r.p))
SELECT n.page_id, n.host, n.path, m.rule, coalesce(m.v, 'allow') AS verdict
FROM n LEFT JOIN m ON n.n = m.n AND m.k = 1
"""
