"""Operator 3: sharding by weighted rendezvous hashing, native expressions only.

Every (key, shard) pair has a hash u in (0, 1); the row goes to the shard with the least -ln(u) / weight. A
shard that is added takes rows into itself and moves no others. Slots number a shard's rows: equal rows are counted
with partial aggregation, counts by (shard, part of a row's digest) give each part its first slot, and only the distinct
rows of one part are ranked together, so no task holds a whole shard or a frequent key.

Defined results: a null id is a key of its own; null texts count no bytes and have the CRC of no bytes;
rows with equal ids share a shard and get slots of their own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import durable, table

#: Hex digits of a row's digest that split a shard for numbering: 16 ** 3 parts of each shard.
PREFIX = 3


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key (a string column, not null) among len(weights) shards."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("weights must be positive")

    def cost(shard: int, weight: float) -> Column:
        drawn = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 12), 16, 10).cast("double")
        return -F.log((drawn + 0.5) / float(1 << 48)) / F.lit(float(weight))

    return F.array_min(F.array(*[F.struct(cost(i, w).alias("cost"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]))["shard"]


def shard_rows(df: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text", grown_weight: float = 1.0) -> DataFrame:
    """Per row: the key, size, text_crc32, law, shard, slot, grown_shard (with one more shard of grown_weight)."""
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(F.col(key).alias("key"), rendezvous(name, weights).alias("shard"), rendezvous(name, [*weights, grown_weight]).alias("grown"),
                     (F.octet_length(body).cast("long") + 8).alias("size"), F.crc32(body.cast("binary")).alias("crc"))
    # Equal rows are one row with a count: they take neighbouring slots.
    rows = rows.groupBy("key", "shard", "grown", "size", "crc").agg(F.count(F.lit(1)).alias("n"))
    part = F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col("key").cast("string"), F.lit("null")), "crc", "size")), 1, PREFIX)
    # Read twice from here on: a table of numbers, so that texts are read once.
    rows = durable(rows.withColumn("part", F.conv(part, 16, 10).cast("int")), "shards")
    # The counts are at most shards x 16 ** PREFIX rows.
    counts = rows.groupBy("shard", "part").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "part").orderBy("key", "crc", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("rank", F.coalesce(F.sum("n").over(within), F.lit(0)))
    out = ranked.join(F.broadcast(first) if len(weights) * 16**PREFIX <= 1 << 20 else first, ["shard", "part"])
    start = F.col("first") + F.col("rank")
    return out.select(F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard",
                      F.explode(F.sequence(start, start + F.col("n") - 1)).alias("slot"), F.col("grown").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), [1.0] * 24)
