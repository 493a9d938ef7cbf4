"""Windows bounded by the data: sessions, states and events. Filters come first; times are sorted, never trusted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import Agg, aggregate
from .. import order
from .buckets import width_micros


def _collected(rows: DataFrame, group: str, ts: str, keys: Sequence[str], aggs: Sequence[Agg], tie: Sequence[str], extra: Sequence[Agg] = ()) -> DataFrame:
    if not aggs:
        raise ValueError("a window needs an aggregate")
    ends = [Agg("min", ts, "window_start"), Agg("max", ts, "window_end")]
    return aggregate(rows, [*ends, *extra, *aggs], [*keys, group], ts, tie, blocks=1).drop(group)


def _islands(df: DataFrame, breaks, ts: str, keys: Sequence[str], tie: Sequence[str], blocks: int | None) -> DataFrame:
    """Numbers runs of rows: breaks(window) is true on the first row of a new run."""
    cut, cuts = order.with_blocks(df.where(F.col(ts).isNotNull()), ts, keys, blocks)
    rows = order.with_ghosts(cut, ts, keys, tie, cuts, before=1)
    rows = rows.withColumn("__new", F.coalesce(breaks(order.block_window(ts, keys, tie)).cast("int"), F.lit(0))).where(~F.col(order.GHOST)).drop(order.GHOST)
    return order.running_total(rows, F.col("__new"), "__island", ts, keys, tie, cuts).drop("__new", order.BLOCK)


def session(df: DataFrame, ts: str, gap: int | str, aggs: Sequence[Agg], keys: Sequence[str] = (), tie: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    """A new window where the time since the row before exceeds gap (an equal gap stays)."""
    g = width_micros(gap)
    rows = _islands(df, lambda w: order.micros(ts) - order.micros(F.lag(ts).over(w)) > g, ts, keys, tie, blocks)
    return _collected(rows, "__island", ts, keys, aggs, tie)


def state_window(df: DataFrame, ts: str, state: str, aggs: Sequence[Agg], keys: Sequence[str] = (), tie: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    """A new window where the state changes; null is a state of its own."""
    rows = _islands(df, lambda w: ~F.col(state).eqNullSafe(F.lag(state).over(w)) & F.lag(F.lit(1)).over(w).isNotNull(), ts, keys, tie, blocks)
    return _collected(rows, "__island", ts, keys, aggs, tie, [Agg("min", state, state)])


def event_window(df: DataFrame, ts: str, start: Column, end: Column, aggs: Sequence[Agg], keys: Sequence[str] = (), tie: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    """Opens on a row where start holds, closes with the row where end holds (maybe the same); a last open window counts.

    Rows where end holds split the series into segments; in a segment the window begins at the first start row.
    """
    cut, cuts = order.with_blocks(df.where(F.col(ts).isNotNull()), ts, keys, blocks)
    true = lambda c: F.coalesce(c, F.lit(False))
    rows = cut.withColumns({"__s": true(start), "__e": true(end)})
    rows = order.running_total(rows, F.col("__e").cast("long"), "__seg", ts, keys, tie, cuts, inclusive=False)
    rows = rows.withColumn("__seg", F.coalesce("__seg", F.lit(0)))
    # Starts up to and including each row, so that "at or after the first start" is a running count within the segment.
    rows = order.running_total(rows, F.col("__s").cast("long"), "__starts", ts, keys, tie, cuts)
    rows = rows.withColumn("__before", F.col("__starts") - F.col("__s").cast("long"))
    first = rows.groupBy(*keys, "__seg").agg(F.min("__before").alias("__base")).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__seg").alias("__g"), "__base")
    same = F.col("__seg") == F.col("__g")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    rows = rows.join(first, same).where(F.col("__starts") > F.col("__base"))
    return _collected(rows, "__seg", ts, keys, aggs, tie)
