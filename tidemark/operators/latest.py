"""The last row of every key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_on(df: DataFrame, ts: str, keys: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """The row with the greatest time of each key (without keys: one row); the tie columns decide among equals.

    An aggregate, so partial results combine before the exchange and a hot key costs one row a task.
    """
    rest = [c for c in df.columns if c not in keys]
    at = F.struct(*[F.col(c) for c in (ts, *tie)])
    best = df.where(F.col(ts).isNotNull()).groupBy(*keys).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), at).alias("__row"))
    return best.where("__row is not null").select(*[F.col(f"`{c}`") if c in keys else F.col(f"__row.`{c}`") for c in df.columns])
