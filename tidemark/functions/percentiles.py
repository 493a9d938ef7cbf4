"""Exact percentiles of groups of any size: a sketch brackets the rank, counts outside the bracket make it exact.

Pass one finds for every group two values between which the asked rank lies, from a sketch of ACCURACY. Pass two
counts the rows below and above them and, by value, those between, about 4 / ACCURACY of a group: with partial
aggregation, so neither pass holds a group's values in a map or meets a large group in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000


def exact_percentiles(df: DataFrame, value: Column, wanted: dict[str, float], keys: Sequence[str] = (), accuracy: int = ACCURACY) -> DataFrame:
    """One row a group with values: the keys and for each name in ``wanted`` the interpolated percentile (0 to 1).

    Nulls don't count; NaN is the greatest value. Groups without values are left out.
    """
    own = [f"__k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], value.cast("double").alias("__v")).where("__v is not null")
    slack, out = 2 / accuracy, None
    sketch = lambda q: F.percentile_approx("__v", F.lit(min(1.0, max(0.0, q))), F.lit(accuracy))
    names = list(wanted)
    found = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("__n"), *[sketch(wanted[c] + s * slack).alias(f"__{e}{i}") for i, c in enumerate(names) for e, s in (("lo", -1), ("hi", 1))])
    bounds = found.select(*[F.col(o).alias(f"{o}b") for o in own], *[c for c in found.columns if c not in own])
    same = F.lit(True)
    for o in own:
        same = same & F.col(o).eqNullSafe(F.col(f"{o}b"))
    met = rows.join(bounds, same)
    zones = []
    for i in range(len(names)):
        zone = F.when(F.col("__v") < F.col(f"__lo{i}"), -1).when(F.col("__v") > F.col(f"__hi{i}"), 1).otherwise(0)
        zones.append(F.struct(F.lit(i).alias("i"), zone.alias("zone"), F.when(zone == 0, F.col("__v")).alias("at")))
    counts = met.withColumn("__z", F.explode(F.array(*zones))).groupBy(*own, "__z").agg(F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__least"), F.max("__v").alias("__most"), F.first("__n").alias("__n"))
    by = Window.partitionBy(*own, "__z.i").orderBy("__z.zone", "__z.at").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__b", F.coalesce(F.sum("__c").over(by), F.lit(0)))
    # Of the rows below the bracket only the last is ever asked for, of those above it only the first.
    v = F.when(F.col("__z.zone") == -1, F.col("__most")).otherwise(F.col("__least"))
    aggs = []
    for i, c in enumerate(names):
        rank = F.lit(min(1.0, max(0.0, wanted[c]))) * (F.col("__n") - 1)
        holds = lambda r: (F.col("__z.i") == i) & (F.col("__b") <= r) & (r < F.col("__b") + F.col("__c"))  # noqa: B023, E731
        low, high = F.max(F.when(holds(F.floor(rank)), v)), F.max(F.when(holds(F.ceil(rank)), v))
        part = F.max(rank - F.floor(rank))
        aggs.append(F.when(part == 0, low).otherwise((1 - part) * low + part * high).alias(c))
    out = counts.groupBy(*own).agg(*aggs)
    return out.select(*[F.col(o).alias(k) for o, k in zip(own, keys, strict=True)], *names)
