"""Tumbling time buckets, gap filling and sliding windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import Agg, aggregate
from .. import order

UNITS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9}


def width_micros(width: int | str) -> int:
    """An interval ('90s', '2h30m', or microseconds) in microseconds."""
    if isinstance(width, int):
        out = width
    else:
        from ..plans.lexer import interval_nanos

        nanos = interval_nanos(width)
        if nanos % 1000:
            raise ValueError("intervals under a microsecond are not kept")
        out = nanos // 1000
    if out <= 0:
        raise ValueError("an interval must be positive")
    return out


def time_bucket(ts: Column | str, width: int | str) -> Column:
    """Start of the epoch-aligned bucket, as timestamp_ntz (floors before 1970 too)."""
    w, us = width_micros(width), order.micros(ts)
    return F.timestamp_micros(us - F.pmod(us, F.lit(w))).cast("timestamp_ntz")


def sample_by(df: DataFrame, ts: str, width: int | str, aggs: Sequence[Agg], keys: Sequence[str] = (), tie: Sequence[str] = (), bucket: str = "bucket", how: str | float | None = None) -> DataFrame:
    """Aggregates per key and bucket; only buckets with rows, unless ``how`` fills the others (see ``fill``)."""
    if not aggs:
        raise ValueError("SAMPLE BY needs an aggregate")
    rows = df.where(F.col(ts).isNotNull()).withColumn("__bucket", time_bucket(ts, width))
    out = aggregate(rows, aggs, [*keys, "__bucket"], ts, tie, blocks=1).withColumnRenamed("__bucket", bucket)
    return out if how is None else fill(out, bucket, width, [a.name for a in aggs], how, keys)


def fill(df: DataFrame, bucket: str, width: int | str, values: Sequence[str], how: str | float, keys: Sequence[str] = ()) -> DataFrame:
    """Adds the missing buckets between each key's first and last. how: "prev", "null", "linear" or a number.

    Every row brings the empty buckets up to the next row, so there is no join with a grid and the only
    window runs over the buckets of a key.
    """
    w = width_micros(width)
    by = Window.partitionBy(*keys).orderBy(bucket)
    us = order.micros(bucket)
    rows = df.withColumn("__next", F.lead(us).over(by)).withColumn("__at", us)
    linear = isinstance(how, str) and how.lower() == "linear"
    if linear:
        rows = rows.withColumns({f"__n{i}": F.lead(c).over(by) for i, c in enumerate(values)})
    grid = F.when(F.col("__next").isNull(), F.array("__at")).otherwise(F.sequence(F.col("__at"), F.col("__next") - w, F.lit(w)))
    rows = rows.withColumn("__g", F.explode(grid))
    new = F.col("__g") != F.col("__at")

    def value(i: int, c: str) -> Column:
        v, kind = F.col(c), df.schema[c].dataType
        if linear:
            part = (F.col("__g") - F.col("__at")) / (F.col("__next") - F.col("__at")).cast("double")
            return F.when(new, v + (F.col(f"__n{i}") - v) * part).otherwise(v.cast("double"))
        if isinstance(how, str) and how.lower() == "prev":
            return v
        if isinstance(how, str) and how.lower() == "null":
            return F.when(~new, v)
        return F.when(new, F.lit(how).cast(kind)).otherwise(v)

    if isinstance(how, str) and how.lower() not in ("prev", "null", "linear"):
        raise ValueError(f"unknown fill: {how}")
    filled = {c: value(i, c).alias(c) for i, c in enumerate(values)}
    at = F.timestamp_micros("__g").cast(df.schema[bucket].dataType).alias(bucket)
    return rows.select(*[at if c == bucket else filled.get(c, F.col(f"`{c}`")) for c in df.columns])


def sliding(df: DataFrame, ts: str, width: str, slide: str, aggs: Sequence[Agg], keys: Sequence[str] = ()) -> DataFrame:
    """Hopping windows: window_start, window_end and the aggregates."""
    w, s = width_micros(width), width_micros(slide)
    rows = df.withColumn("__w", F.window(ts, f"{w} microseconds", f"{s} microseconds"))
    out = aggregate(rows, aggs, [*keys, "__w"], ts, blocks=1)
    return out.select(*keys, F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"), *[F.col(f"`{a.name}`") for a in aggs])
