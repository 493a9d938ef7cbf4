"""Ordered work in time, with or without keys, without one task for a whole series.

A series of more than BLOCK_ROWS rows is cut into blocks of time at quantiles of its timestamps, as many as its rows ask
for. Windows run inside (keys, block); what a block needs from its neighbours comes as a few ghost rows (the last rows
before it, the first after it) or as an offset from per-block totals. Of keyed series only the hot ones, those with
more rows than that, are cut; all others are one block, a plain keyed window. Input whose planned size is under
BLOCK_BYTES is not counted at all and stays whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, GHOST = "__block", "__ghost"
#: The block of rows whose key is not cut.
WHOLE = -1
BLOCK_BYTES, BLOCK_ROWS, MOST_BLOCKS = 64 << 20, 2_000_000, 1 << 16
#: Cuts compared at once on the way down to a block.
FANOUT = 64


def micros(ts: Column | str) -> Column:
    """A timestamp (with or without zone; the session is in UTC) as microseconds since the epoch."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of df."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _conf(df: DataFrame, name: str, default: int) -> int:
    return int(df.sparkSession.conf.get(f"spark.tidemark.{name}", str(default)))


def _quantiles(df: DataFrame, ts: str, parts: int) -> list[int]:
    at = [i / parts for i in range(1, parts)]
    found = df.select(F.percentile_approx(micros(ts), F.array(*map(F.lit, at)), F.lit(max(1000, 8 * parts))).alias("q")).first()[0]
    return sorted(set(found or []))


def _cuts(df: DataFrame, ts: str, keys: Sequence[str], blocks: int | None) -> tuple[list[int], DataFrame | None]:
    """The cuts, and the keys that they are for where these are not all."""
    own = df.sparkSession.conf.get("spark.tidemark.blocks", None)
    blocks = blocks or (int(own) if own else None)
    if blocks:
        return _quantiles(df, ts, blocks) if blocks > 1 else [], None
    if planned_bytes(df) <= _conf(df, "blockBytes", BLOCK_BYTES):
        return [], None
    most = _conf(df, "blockRows", BLOCK_ROWS)
    if not keys:
        parts = min(MOST_BLOCKS, -(-df.count() // most))
        return _quantiles(df, ts, parts) if parts > 1 else [], None
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most)
    largest = counts.agg(F.max("__n")).first()[0]
    if not largest:
        return [], None
    hot = counts.select(*[F.col(k).alias(f"__h{i}") for i, k in enumerate(keys)])  # at most rows / blockRows of them
    cuts = _quantiles(df.join(hot, _same(keys, hot.columns), "left_semi"), ts, min(MOST_BLOCKS, -(-largest // most)))
    return cuts, hot


def _same(keys: Sequence[str], others: Sequence[str]) -> Column:
    out = F.lit(True)
    for k, o in zip(keys, others, strict=True):
        out = out & F.col(k).eqNullSafe(F.col(o))
    return out


def _number(t: Column, cuts: Sequence[int]) -> Column:
    """How many of the sorted cuts are at or before t, by a search with FANOUT ways a level."""
    if len(cuts) < FANOUT:
        out = F.lit(0)
        for c in cuts:
            out = out + (t >= F.lit(int(c))).cast("int")
        return out
    step = FANOUT
    while step * FANOUT <= len(cuts):
        step *= FANOUT
    out = F.size(F.filter(F.lit([int(c) for c in cuts[step - 1 :: step]]), lambda c: c <= t)) * step
    held = F.lit([int(c) for c in cuts])
    while step > 1:
        step //= FANOUT
        # Every step-th of the next cuts: those after the ones already passed.
        nodes = F.lit([int(c) for c in cuts[step - 1 :: step]]) if step > 1 else held
        out = out + F.size(F.filter(F.slice(nodes, F.call_function("div", out, F.lit(step)).cast("int") + 1, FANOUT - 1), lambda c: c <= t)) * step
    return out


def with_blocks(df: DataFrame, ts: str, keys: Sequence[str] = (), blocks: int | None = None) -> tuple[DataFrame, list]:
    """df with its block number, and the cuts (timestamps that begin a block). Equal timestamps share a block.

    ``blocks``, or else ``spark.tidemark.blocks``, cuts every series into that many; 1 cuts none.
    """
    cuts, hot = _cuts(df, ts, keys, blocks)
    if not cuts:
        return df.withColumn(BLOCK, F.lit(0)), []
    number = F.coalesce(_number(micros(ts), cuts), F.lit(0))
    if hot is None:
        return df.withColumn(BLOCK, number), cuts
    marked = hot.withColumn("__hot", F.lit(True))
    small = planned_bytes(df) // (_conf(df, "blockRows", BLOCK_ROWS) * 8) <= BLOCK_BYTES  # rows of at least 8 bytes
    out = df.join(F.broadcast(marked) if small else marked, _same(keys, hot.columns), "left")
    return out.withColumn(BLOCK, F.when(F.col("__hot"), number).otherwise(F.lit(WHOLE))).drop("__hot", *hot.columns), cuts


def ordering(ts: str, tie: Sequence[str] = (), descending: bool = False) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c) for c in (ts, *tie)]


def block_window(ts: str, keys: Sequence[str], tie: Sequence[str] = ()):
    return Window.partitionBy(*keys, BLOCK).orderBy(*ordering(ts, tie))


def with_ghosts(df: DataFrame, ts: str, keys: Sequence[str], tie: Sequence[str], cuts: list, before: int = 0, after: int = 0) -> DataFrame:
    """Adds to every block the last ``before`` rows of earlier blocks and the first ``after`` of later ones, marked as ghosts."""
    own = df.withColumn(GHOST, F.lit(False))
    if not cuts:
        return own
    top = len(cuts)
    for n, down in ((before, True), (after, False)):
        if not n:
            continue
        rank = Window.partitionBy(*keys, BLOCK).orderBy(*ordering(ts, tie, down))
        edge = df.withColumn("__r", F.row_number().over(rank)).where(F.col("__r") <= n)
        edge = edge.where((F.col(BLOCK) < top) & (F.col(BLOCK) != WHOLE) if down else F.col(BLOCK) > 0)
        # A row serves the blocks up to that of the n-th edge row beyond it, so every block gets n rows and no more are made.
        beyond = F.lead(BLOCK, n).over(Window.partitionBy(*keys).orderBy(F.col(BLOCK) if down else F.col(BLOCK).desc(), F.col("__r").desc()))
        edge = edge.withColumn("__l", beyond)
        to = F.sequence(F.col(BLOCK) + 1, F.coalesce("__l", F.lit(top))) if down else F.sequence(F.coalesce("__l", F.lit(0)), F.col(BLOCK) - 1)
        edge = edge.withColumn("__to", F.explode(to))
        ghosts = edge.withColumn(BLOCK, F.col("__to")).drop("__r", "__l", "__to").withColumn(GHOST, F.lit(True))
        own = own.unionByName(ghosts.select(own.columns))
    return own


def running_total(df: DataFrame, value: Column, to: str, ts: str, keys: Sequence[str], tie: Sequence[str], cuts: list, inclusive: bool = True) -> DataFrame:
    """Adds the running sum of value (nulls count nothing) over the series as column ``to``."""
    last = 0 if inclusive else -1
    w = block_window(ts, keys, tie).rowsBetween(Window.unboundedPreceding, last)
    out = df.withColumn("__v", value).withColumn(to, F.sum("__v").over(w))
    if cuts:
        totals = out.groupBy(*keys, BLOCK).agg(F.sum("__v").alias("__t"))
        earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.withColumn("__o", F.sum("__t").over(earlier)).drop("__t").where("__o is not null")
        offsets = offsets.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(BLOCK).alias("__b"), "__o")
        same = F.col(BLOCK) == F.col("__b")
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
        out = out.join(offsets, same, "left").drop("__b", *[f"__k{i}" for i in range(len(keys))])
        out = out.withColumn(to, F.when(F.col(to).isNull() & F.col("__o").isNull(), None).otherwise(F.coalesce(F.col(to), F.lit(0)) + F.coalesce("__o", F.lit(0)))).drop("__o")
    return out.drop("__v")


def _lost(a: Column, b: Column, s: Column) -> Column:
    """What rounding took from s = a + b, exactly; null once s is not finite."""
    part = s - a
    return F.when(F.abs(s) < float("inf"), (a - (s - part)) + (b - part))


def _or_zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def _carried(df: DataFrame, value: Column, w) -> DataFrame:
    """Adds the running sum of value as __s, that of the rows before as __b, and what its additions lost as __e."""
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("__v", value)
    out = out.withColumns({"__s": F.sum("__v").over(upto), "__b": F.sum("__v").over(w.rowsBetween(Window.unboundedPreceding, -1))})
    return out.withColumn("__e", _lost(_or_zero("__b"), _or_zero("__v"), F.col("__s"))).drop("__v")


def running_sum(df: DataFrame, value: Column, to: str, ts: str, keys: Sequence[str], tie: Sequence[str], cuts: list, base: DataFrame | None = None) -> DataFrame:
    """Adds the running sum of a double (nulls count nothing) over the series as column ``to``.

    A sum of millions of doubles in turn drifts by many units of its last place, so what each addition loses is summed beside it and
    added at the end, within blocks and over them. Block totals come from ``base``, the same rows by a shorter plan.
    """
    w = block_window(ts, keys, tie)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = _carried(df, value, w).withColumn("__c", F.sum("__e").over(upto)).drop("__b", "__e")
    if not cuts:
        return out.withColumn(to, F.col("__s") + _or_zero("__c")).drop("__s", "__c")
    base = df if base is None else base
    if keys:
        base = base.where(F.col(BLOCK) != WHOLE)
    ends = _carried(base, value, w).withColumn("__c", F.sum("__e").over(upto)).withColumn("__next", F.lead(F.lit(1)).over(w)).where("__next is null")
    ends = ends.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(BLOCK).alias("__n"), F.col("__s").alias("__t"), F.col("__c").alias("__tc"))
    names = [f"__k{i}" for i in range(len(keys))]
    over = Window.partitionBy(*names).orderBy("__n")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    offsets = _carried(ends, F.col("__t"), over).withColumn("__oc", F.sum(_or_zero("__e") + _or_zero("__tc")).over(earlier))
    offsets = offsets.where("__b is not null").select(*names, "__n", F.col("__b").alias("__o"), "__oc")
    # Without keys there is one row a block.
    out = out.join(offsets if keys else F.broadcast(offsets), (F.col(BLOCK) == F.col("__n")) & _same(keys, names), "left")
    both = _or_zero("__o") + _or_zero("__s")
    rest = F.coalesce(_lost(_or_zero("__o"), _or_zero("__s"), both), F.lit(0.0)) + (_or_zero("__c") + _or_zero("__oc"))
    out = out.withColumn(to, F.when(F.col("__s").isNotNull() | F.col("__o").isNotNull(), both + rest))
    return out.drop("__s", "__c", "__n", "__o", "__oc", *names)
