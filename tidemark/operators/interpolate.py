"""Linear interpolation on a regular grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import order
from .buckets import width_micros


def interp(df: DataFrame, ts: str, c: str, width: int | str, to: str | None = None, keys: Sequence[str] = (), tie: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    """(keys, ts, value) at every grid instant inside the data: a point's own value or the line between its neighbours.

    Every point brings the grid instants from itself up to the next point, so no grid is joined. Of several points of
    one instant the last counts. Fewer than two points give no rows.
    """
    w, to = width_micros(width), to or c
    points = df.where(F.col(ts).isNotNull() & F.col(c).isNotNull()).select(*keys, F.col(ts).alias("__t"), F.col(c).cast("double").alias("__v"), *[F.col(x).alias(f"__tie{i}") for i, x in enumerate(tie)])
    last = F.struct(*[F.col(f"__tie{i}") for i in range(len(tie))], F.col("__v")) if tie else F.col("__v")
    points = points.groupBy(*keys, "__t").agg(F.max_by("__v", last).alias("__v"))
    cut, cuts = order.with_blocks(points, "__t", keys, blocks)
    rows = order.with_ghosts(cut, "__t", keys, (), cuts, before=1, after=1)
    win = Window.partitionBy(*keys, order.BLOCK).orderBy("__t")
    us = order.micros("__t")
    rows = rows.withColumns({"__at": us, "__next": F.lead(us).over(win), "__nv": F.lead("__v").over(win), "__only": F.lag(us).over(win).isNull()}).where(~F.col(order.GHOST))
    first = F.col("__at") + F.pmod(-F.col("__at"), F.lit(w))  # the first grid instant at or after the point
    stop = F.coalesce(F.col("__next") - 1, F.when(~F.col("__only"), F.col("__at")))
    rows = rows.withColumns({"__a": first, "__b": stop}).where("__a <= __b").withColumn("__g", F.explode(F.sequence("__a", "__b", F.lit(w))))
    value = F.when(F.col("__g") == F.col("__at"), F.col("__v")).otherwise(F.col("__v") + (F.col("__nv") - F.col("__v")) * ((F.col("__g") - F.col("__at")) / (F.col("__next") - F.col("__at")).cast("double")))
    return rows.select(*keys, F.timestamp_micros("__g").cast(df.schema[ts].dataType).alias(ts), value.alias(to))
