"""User functions: scalar ones, vectorised, for projections and inside aggregates; aggregates of partial states; table functions."""

from __future__ import annotations

import importlib
import inspect
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

TYPES = {"TIMESTAMP": "timestamp_ntz", "INT64": "long", "FLOAT64": "double"}
MAX_ARGS = 8
BUILT_IN = {"count", "sum", "avg", "min", "max", "spread", "p50", "p90", "p99", "percentile", "approx_percentile", "stddev", "first", "last", "last_row", "twa", "diff", "derivative", "csum", "mavg", "lag", "interp", "time_bucket"}


class FunctionRegistry:
    """Functions take and return pandas Series of equal length and keep no state."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._held: dict[str, tuple[list[str], str, Callable, str]] = {}

    def create(self, name: str, args: Sequence[str], returns: str, fn: Callable | str) -> None:
        """fn: a callable, or "module:function" to import."""
        key = name.lower()
        if key in BUILT_IN:
            raise ValueError(f"{name} is built in")
        if key in self._held:
            raise ValueError(f"function exists: {name}")
        args, returns = [a.upper() for a in args], returns.upper()
        if not 1 <= len(args) <= MAX_ARGS or any(t not in TYPES for t in (*args, returns)):
            raise ValueError(f"functions take 1 to {MAX_ARGS} arguments of {', '.join(TYPES)}")
        where = fn if isinstance(fn, str) else f"{fn.__module__}:{fn.__qualname__}"
        if isinstance(fn, str):
            module, _, attr = fn.partition(":")
            fn = getattr(importlib.import_module(module), attr or name)
        if len(inspect.signature(fn).parameters) != len(args):
            raise ValueError("the function's parameters don't match its declaration")
        self._held[key] = (args, returns, fn, where)

    def drop(self, name: str) -> None:
        if self._held.pop(name.lower(), None) is None:
            raise KeyError(f"no function {name}")

    def __contains__(self, name: str) -> bool:
        return name.lower() in self._held

    def call(self, name: str, *cols: Column) -> Column:
        args, returns, fn, _ = self._held[name.lower()]
        if len(cols) != len(args):
            raise ValueError(f"{name} takes {len(args)} arguments")

        ship(self.spark)

        def run(*series: pd.Series) -> pd.Series:
            return fn(*series)

        vector = F.pandas_udf(run, TYPES[returns], F.PandasUDFType.SCALAR)
        return vector(*[c.cast(TYPES[t]) for c, t in zip(cols, args, strict=True)])

    def rows(self) -> list[tuple[str, int, str, str]]:
        return [(n, len(a), r, w) for n, (a, r, _, w) in sorted(self._held.items())]


def aggregate_by(df: DataFrame, keys: Sequence[str], columns: Sequence[str], state: str, partial: Callable[[pd.DataFrame], Sequence], returns: str, merge: Callable[[pd.DataFrame], object], to: str) -> DataFrame:
    """A user's aggregate. ``partial`` turns rows (the columns) of one group into one state (DDL ``state``), batch by batch where
    the rows are; only states are exchanged, and ``merge`` turns a group's states into the result of type ``returns``.

    A group gives at most one state a batch. No rows, no groups; without keys the result is one row.
    """
    ship(df.sparkSession)
    own = [f"k{i}" for i in range(len(keys))]
    one = own or ["k0"]
    rows = df.select(*([F.col(f"`{k}`").alias(o) for k, o in zip(keys, own, strict=True)] or [F.lit(0).alias("k0")]), *[F.col(f"`{c}`") for c in columns])
    names = [f.split()[0] for f in state.split(",")]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[: len(one)])

    def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                found = [(*key, *partial(group[list(columns)])) for key, group in batch.groupby(one, dropna=False, sort=False)]
                yield pd.DataFrame(found, columns=[*one, *names])

    def merged(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, merge(pdf[names]))], columns=[*one, to])

    out = rows.mapInPandas(states, f"{kinds}, {state}").groupBy(*one).applyInPandas(merged, f"{kinds}, `{to}` {returns}")
    return out.select(*[F.col(o).alias(k) for k, o in zip(keys, own, strict=True)], F.col(f"`{to}`"))


def rows_from(df: DataFrame, columns: Sequence[str], returns: str, fn: Callable[..., Iterator[tuple]]) -> DataFrame:
    """A user's table function: for every row of df the rows that ``fn(*columns)`` yields (DDL ``returns``), beside df's columns."""
    ship(df.sparkSession)

    class Table:
        def eval(self, *values):
            yield from fn(*values)

    made = F.udtf(Table, returnType=returns)
    return df.lateralJoin(made(*[F.col(c).outer() for c in columns]))
