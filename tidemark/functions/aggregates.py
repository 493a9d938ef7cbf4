"""The aggregates of the dialect, over whole tables, keys or windows.

first, last, last_row and twa follow time; equal times go by the tie columns. Percentiles are exact by
default and interpolate; ``approx`` (in the language approx_percentile, or ``spark.tidemark.percentiles=sketch`` for
all of them) asks for sketches of relative rank error 1 / 10,000. Exact ones of inputs over PERCENTILE_BYTES come from
``exact_percentiles``, without a map of a group's values. Over no rows every aggregate but count is null.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import order
from .percentiles import exact_percentiles

NAMES = ("count", "sum", "avg", "min", "max", "spread", "p50", "p90", "p99", "percentile", "stddev", "first", "last", "last_row", "twa", "count_distinct", "approx_count_distinct")
QUANTILES = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
PERCENTILES = (*QUANTILES, "percentile")
PERCENTILE_BYTES = 64 << 20


@dataclass(frozen=True)
class Agg:
    """One aggregate: fn over a column, expression or nothing (count)."""

    fn: str
    arg: Column | str | None = None
    alias: str | None = None
    q: float | None = None
    approx: bool = False

    @property
    def name(self) -> str:
        return self.alias or f"{self.fn}({self.arg if isinstance(self.arg, str) else '*' if self.arg is None else 'expr'})"

    def value(self) -> Column:
        return F.col(self.arg) if isinstance(self.arg, str) else self.arg

    @property
    def quantile(self) -> float:
        q = QUANTILES.get(self.fn, self.q)
        if q is None:
            raise ValueError("percentile needs a quantile")
        return min(1.0, max(0.0, float(q)))

    def column(self, ts: str | None, tie: Sequence[str], i: int) -> Column:
        if self.fn not in NAMES:
            raise ValueError(f"unknown aggregate: {self.fn}")
        if self.fn == "count":
            return F.count(F.lit(1)) if self.arg is None else F.count(self.value())
        v = F.col(f"__a{i}")
        if self.fn in PERCENTILES:
            return F.percentile_approx(v.cast("double"), F.lit(self.quantile), F.lit(10000)) if self.approx else F.percentile(v, F.lit(self.quantile))
        if self.fn in ("first", "last", "last_row"):
            if ts is None:
                raise ValueError(f"{self.fn} needs a time column")
            at = F.when(v.isNotNull(), F.struct(*[F.col(c) for c in (ts, *tie)]))
            return (F.min_by if self.fn == "first" else F.max_by)(v, at)
        if self.fn == "twa":
            span = order.micros(F.max(F.when(v.isNotNull(), F.col(ts)))) - order.micros(F.min(F.when(v.isNotNull(), F.col(ts))))
            at = F.when(v.isNotNull(), F.struct(*[F.col(c) for c in (ts, *tie)]))
            return F.when(span == 0, F.max_by(v.cast("double"), at)).otherwise(F.try_divide(F.sum(v * F.col(f"__d{i}")), span.cast("double")))
        simple = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "stddev": F.stddev_pop, "count_distinct": F.countDistinct, "approx_count_distinct": F.approx_count_distinct}
        return F.max(v) - F.min(v) if self.fn == "spread" else simple[self.fn](v)


def aggregate(df: DataFrame, aggs: Sequence[Agg], keys: Sequence[str] = (), ts: str | None = None, tie: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    """groupBy(keys).agg(aggs); without keys one row."""
    made = df.withColumns({f"__a{i}": a.value() for i, a in enumerate(aggs) if a.fn != "count"})
    for i, a in enumerate(aggs):
        if a.fn != "twa":
            continue
        if ts is None:
            raise ValueError("twa needs a time column")
        # The gap to the row before: that row's value is not needed, so nulls are left out first.
        cut, cuts = order.with_blocks(made, ts, keys, blocks)
        known = cut.where(F.col(f"__a{i}").isNotNull())
        rows = order.with_ghosts(known, ts, keys, tie, cuts, before=1)
        gap = order.micros(ts) - order.micros(F.lag(ts).over(order.block_window(ts, keys, tie)))
        rows = rows.withColumn(f"__d{i}", F.coalesce(gap, F.lit(0)).cast("double")).where(~F.col(order.GHOST)).drop(order.GHOST)
        rest = cut.where(F.col(f"__a{i}").isNull()).withColumn(f"__d{i}", F.lit(0.0))
        made = rows.unionByName(rest.select(rows.columns)).drop(order.BLOCK)
    conf = df.sparkSession.conf
    if conf.get("spark.tidemark.percentiles", "exact") == "sketch":
        aggs = [replace(a, approx=True) if a.fn in PERCENTILES else a for a in aggs]
    exact = {i: a for i, a in enumerate(aggs) if a.fn in PERCENTILES and not a.approx}
    if exact and not df.isStreaming and order.planned_bytes(made) > int(conf.get("spark.tidemark.percentileBytes", str(PERCENTILE_BYTES))):
        return _with_percentiles(made, aggs, exact, keys, ts, tie)
    return made.groupBy(*keys).agg(*[a.column(ts, tie, i).alias(a.name) for i, a in enumerate(aggs)])


def _with_percentiles(made: DataFrame, aggs: Sequence[Agg], exact: dict[int, Agg], keys: Sequence[str], ts: str | None, tie: Sequence[str]) -> DataFrame:
    rest = [a.column(ts, tie, i).alias(a.name) for i, a in enumerate(aggs) if i not in exact]
    out = made.groupBy(*keys).agg(*(rest or [F.count(F.lit(1)).alias("__rows")]))
    by_value: dict[str, dict[int, Agg]] = {}
    for i, a in exact.items():
        by_value.setdefault(a.arg if isinstance(a.arg, str) else str(a.arg), {})[i] = a
    for group in by_value.values():
        found = exact_percentiles(made, F.col(f"__a{min(group)}"), {f"__p{i}": a.quantile for i, a in group.items()}, keys)
        found = found.select(*[F.col(k).alias(f"__j{n}") for n, k in enumerate(keys)], *[F.col(f"__p{i}").alias(a.name) for i, a in group.items()])
        same = F.lit(True)
        for n, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"__j{n}"))
        out = out.join(found, same, "left").drop(*[f"__j{n}" for n in range(len(keys))])
    return out.select(*[F.col(f"`{k}`") for k in keys], *[F.col(f"`{a.name}`") for a in aggs])


def over(agg: Agg, window: Window) -> Column:
    """The aggregate over an SQL window frame."""
    v = agg.value() if agg.arg is not None else None
    if agg.fn == "count":
        return (F.count(F.lit(1)) if v is None else F.count(v)).over(window)
    if agg.fn == "spread":
        return F.max(v).over(window) - F.min(v).over(window)
    simple = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "stddev": F.stddev_pop, "first": F.first, "last": F.last}
    return simple[agg.fn](v).over(window)
