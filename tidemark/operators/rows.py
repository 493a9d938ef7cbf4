"""Row functions over a series in time order: each adds a column. The first rows, which lack a past, are null."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import order

MOST = 64


def _bounded(n: int) -> int:
    if not 1 <= n <= MOST:
        raise ValueError(f"row counts go from 1 to {MOST}")
    return n


def row_functions(df: DataFrame, ts: str, wanted: dict[str, Callable], before: int, keys: Sequence[str] = (), tie: Sequence[str] = (), blocks: int | None = None, sums: Mapping[str, str] | None = None) -> DataFrame:
    """Adds columns made from a window in which up to ``before`` earlier rows can be seen, by one pass, and running sums of the columns in ``sums``."""
    cut, cuts = order.with_blocks(df, ts, keys, blocks)
    rows = cut
    if wanted:
        w = order.block_window(ts, keys, tie)
        rows = order.with_ghosts(cut, ts, keys, tie, cuts, before=before)
        rows = rows.withColumns({name: make(w) for name, make in wanted.items()}).where(~F.col(order.GHOST)).drop(order.GHOST)
    for to, c in (sums or {}).items():
        rows = order.running_sum(rows, _double(c), to, ts, keys, tie, cuts, cut)
    return rows.drop(order.BLOCK)


def _double(c: str) -> Column:
    return F.col(c).cast("double")


def diff_of(c: str) -> Callable:
    return lambda w: _double(c) - F.lag(_double(c)).over(w)


def derivative_of(c: str, ts: str, quotient: bool = False) -> Callable:
    """Between rows of one instant 0, or with ``quotient`` that of floating-point numbers: infinite, or NaN if nothing changes."""

    def make(w):
        dt = (order.micros(ts) - order.micros(F.lag(ts).over(w))).cast("double")
        dv = _double(c) - F.lag(_double(c)).over(w)
        return F.when(dt == 0, dv * float("inf") if quotient else F.lit(0.0)).otherwise(F.try_divide(dv, dt / 1e6))

    return make


def mavg_of(c: str, n: int) -> Callable:
    return lambda w: F.avg(_double(c)).over(w.rowsBetween(-(_bounded(n) - 1), 0))


def lag_of(c: str, n: int = 1) -> Callable:
    return lambda w: F.lag(_double(c), _bounded(n)).over(w)


def diff(df: DataFrame, ts: str, c: str, to: str, keys: Sequence[str] = (), tie: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    return row_functions(df, ts, {to: diff_of(c)}, 1, keys, tie, blocks)


def derivative(df: DataFrame, ts: str, c: str, to: str, keys: Sequence[str] = (), tie: Sequence[str] = (), blocks: int | None = None, quotient: bool = False) -> DataFrame:
    """Change per second; 0 between rows of one instant, or infinite or NaN with ``quotient``."""
    return row_functions(df, ts, {to: derivative_of(c, ts, quotient)}, 1, keys, tie, blocks)


def mavg(df: DataFrame, ts: str, c: str, n: int, to: str, keys: Sequence[str] = (), tie: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    """Mean of the row and up to n - 1 before it."""
    return row_functions(df, ts, {to: mavg_of(c, n)}, _bounded(n), keys, tie, blocks)


def lag(df: DataFrame, ts: str, c: str, n: int, to: str, keys: Sequence[str] = (), tie: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    return row_functions(df, ts, {to: lag_of(c, n)}, _bounded(n), keys, tie, blocks)


def csum(df: DataFrame, ts: str, c: str, to: str, keys: Sequence[str] = (), tie: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    return row_functions(df, ts, {}, 0, keys, tie, blocks, {to: c})
