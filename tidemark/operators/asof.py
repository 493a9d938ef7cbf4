"""Backward as-of join: every left row with the last right row at or before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import order


def asof_join(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, on: Sequence[tuple[str, str] | str] = (), tie: Sequence[str] = (), prefix: str = "r_", blocks: int | None = None) -> DataFrame:
    """All left columns and the right columns, prefixed where the name is taken. Unmatched right columns are null.

    Both sides are sorted once as one stream, right rows first at equal times, so the match is inclusive and
    costs one exchange. Among right rows of one instant the tie columns decide, the last wins. Where a series is cut
    into blocks (see ``order``) its last right row is carried over from earlier blocks.
    """
    pairs = [(k, k) if isinstance(k, str) else k for k in on]
    keys = [f"__k{i}" for i in range(len(pairs))]
    names = {c: c if c not in left.columns else prefix + c for c in right.columns}
    packed = F.struct(*[F.col(f"`{c}`").alias(names[c]) for c in right.columns])
    kind = [F.col(a) for a, _ in pairs]
    lefts = left.select(*[c.alias(k) for c, k in zip(kind, keys, strict=True)], F.col(left_ts).alias("__t"), F.lit(1).alias("__side"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("__l"))
    order_of = [F.col(c) for c in tie]
    rights = right.where(F.col(right_ts).isNotNull()).select(*[F.col(b).alias(k) for (_, b), k in zip(pairs, keys, strict=True)], F.col(right_ts).alias("__t"), F.lit(0).alias("__side"), packed.alias("__r"), F.struct(*order_of).alias("__tie") if tie else F.lit(0).alias("__tie"))
    both = lefts.unionByName(rights, allowMissingColumns=True)
    cut, cuts = order.with_blocks(both, "__t", keys, blocks)
    w = Window.partitionBy(*keys, order.BLOCK).orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    rows = cut.withColumn("__m", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    if cuts:
        ends = cut.where((F.col("__side") == 0) & (F.col(order.BLOCK) != order.WHOLE)).groupBy(*keys, order.BLOCK).agg(F.max_by("__r", F.struct("__t", "__tie")).alias("__c"))
        following = F.lead(order.BLOCK).over(Window.partitionBy(*keys).orderBy(order.BLOCK))
        ends = ends.withColumn("__to", F.coalesce(following, F.lit(len(cuts)))).where(F.col(order.BLOCK) < F.col("__to"))
        ends = ends.withColumn("__b", F.explode(F.sequence(F.col(order.BLOCK) + 1, F.col("__to")))).select(*[F.col(k).alias(f"{k}r") for k in keys], "__b", "__c")
        same = F.col(order.BLOCK) == F.col("__b")
        for k in keys:
            same = same & (F.col(k) == F.col(f"{k}r"))
        rows = rows.join(ends, same, "left").withColumn("__m", F.coalesce("__m", "__c"))
    matched = F.col("__m")
    for k in keys:  # null keys match nothing
        matched = F.when(F.col(k).isNotNull(), matched)
    matched = F.when(F.col("__t").isNotNull(), matched)
    rows = rows.withColumn("__m", matched)
    return rows.select("__l.*", *[F.col(f"__m.`{n}`") for n in names.values()])
