"""Families of tables with one schema: children, their tags, and queries over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import Agg, aggregate
from ..order import planned_bytes


def with_tags(rows: DataFrame, tags: DataFrame, child: str = "tbname", where: Column | None = None, most_bytes: int = 64 << 20) -> DataFrame:
    """Rows of all children joined with their tags; a tag filter leaves only matching children.

    The dimension is broadcast only if its planned size is within most_bytes.
    """
    chosen = tags if where is None else tags.where(where)
    return rows.join(F.broadcast(chosen) if planned_bytes(chosen) <= most_bytes else chosen, child)


def union_children(children: dict[str, DataFrame], tags: dict[str, dict[str, object]], child: str = "tbname") -> DataFrame:
    """One DataFrame of children kept apart, with their name and tags as columns."""
    out = None
    for name, df in children.items():
        one = df.withColumns({child: F.lit(name)} | {k: F.lit(v) for k, v in tags.get(name, {}).items()})
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no children")
    return out


def by_child(df: DataFrame, aggs: Sequence[Agg], ts: str | None = None, child: str = "tbname") -> DataFrame:
    """PARTITION BY tbname: the aggregates of every child."""
    return aggregate(df, aggs, [child], ts, blocks=1)


def merge_partials(parts: DataFrame, keys: Sequence[str], counts: Sequence[str] = (), sums: Sequence[str] = (), mins: Sequence[str] = (), maxs: Sequence[str] = (), avgs: Sequence[tuple[str, str, str]] = ()) -> DataFrame:
    """Final step over partial results of several clusters: counts and sums add, avg = sum / count."""
    cols = [F.sum(c).alias(c) for c in (*counts, *sums)] + [F.min(c).alias(c) for c in mins] + [F.max(c).alias(c) for c in maxs]
    out = parts.groupBy(*keys).agg(*cols)
    return out.withColumns({to: F.try_divide(F.col(s).cast("double"), F.col(n)) for to, s, n in avgs}) if avgs else out


def federated(sources: Sequence[DataFrame]) -> DataFrame:
    """Rows of several clusters as one; aggregate once on top."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out
