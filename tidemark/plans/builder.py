"""From a parsed SELECT to a DataFrame. Rules beyond plain SQL: time is the table's own column, and windows are clauses."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import operators as ops
from ..operators import buckets
from ..functions.aggregates import Agg, aggregate
from ..functions.udf import FunctionRegistry
from ..operators import rows as row_ops
from . import ast as a
from .lexer import QueryError

AGGREGATES = {"count", "sum", "avg", "min", "max", "spread", "p50", "p90", "p99", "percentile", "approx_percentile", "stddev", "first", "last", "last_row", "twa"}
ROW_FUNCTIONS = {"diff", "derivative", "csum", "mavg", "lag"}
_INSTANT = re.compile(r"\d{4}-\d\d-\d\d(?:[ T]\d\d:\d\d:\d\d(?:\.\d{1,9})?)?.*")


@dataclass
class Source:
    """A table to select from."""

    df: DataFrame
    ts: str | None
    tie: Sequence[str] = ()
    part: str | None = None  # partition column yyyyMMdd[HH], to prune by time


class Builder:
    def __init__(self, resolve: Callable[[str], Source], functions: FunctionRegistry | None = None):
        self.resolve, self.functions = resolve, functions

    # expressions
    def _column(self, df: DataFrame, name: str) -> str:
        if name in df.columns:
            return name
        same = [c for c in df.columns if c.lower() == name.lower()]
        if len(same) != 1:
            raise QueryError(f"unknown column {name}")
        return same[0]

    def _kind(self, df: DataFrame, e) -> T.DataType | None:
        return df.schema[self._column(df, e.name)].dataType if isinstance(e, a.Name) else None

    def _literal(self, value, kind: T.DataType | None) -> Column:
        """Literals follow the column they meet: text and whole numbers become instants beside a time column."""
        if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
            if isinstance(value, str):
                if not _INSTANT.fullmatch(value):
                    raise QueryError(f"not a time: {value}")
                return F.lit(re.sub(r"^(.{10}(?:[ T].{8}(?:\.\d{1,6})?)?).*$", r"\1", value)).cast(kind)
            if isinstance(value, int):
                return F.timestamp_micros(F.lit(value // 1000)).cast(kind)
        return F.lit(value)

    def expr(self, df: DataFrame, e, near=None) -> Column:
        """near: the other side of a comparison, which types a literal."""
        if isinstance(e, a.Literal):
            return self._literal(e.value, self._kind(df, near))
        if isinstance(e, a.Interval):
            return F.lit(e.nanos)
        if isinstance(e, a.Name):
            return F.col(f"`{self._column(df, e.name)}`")
        if isinstance(e, a.Unary):
            inner = self.expr(df, e.arg, near)
            return self._truth(df, e.arg, inner, True) if e.op == "NOT" else -inner
        if isinstance(e, a.Binary):
            if e.op in ("AND", "OR"):
                left, right = (self._truth(df, x, self.expr(df, x)) for x in (e.left, e.right))
                return left & right if e.op == "AND" else left | right
            if e.op in "+-*/%":
                left, right = (self._number(df, x) for x in (e.left, e.right))
                return {"+": left + right, "-": left - right, "*": left * right, "/": F.try_divide(left, right), "%": F.try_mod(left, right)}[e.op]
            left, right = self.expr(df, e.left, e.right), self.expr(df, e.right, e.left)
            return {"=": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[e.op]
        if isinstance(e, a.In):
            found = self.expr(df, e.arg).isin(*[self.expr(df, x, e.arg) for x in e.items])
            return ~found if e.negated else found
        if isinstance(e, a.Between):
            found = self.expr(df, e.arg).between(self.expr(df, e.low, e.arg), self.expr(df, e.high, e.arg))
            return ~found if e.negated else found
        if isinstance(e, a.IsNull):
            inner = self.expr(df, e.arg)
            return inner.isNotNull() if e.negated else inner.isNull()
        if isinstance(e, a.Call):
            if e.fn == "time_bucket":
                return self._bucket(df, e)
            if self.functions is not None and e.fn in self.functions:
                return self.functions.call(e.fn, *[self.expr(df, x) for x in e.args])
            raise QueryError(f"unknown function {e.fn}" if e.fn not in AGGREGATES | ROW_FUNCTIONS else f"{e.fn} is not allowed here")
        raise QueryError("expected an expression")

    def _truth(self, df: DataFrame, e, c: Column, negated: bool = False) -> Column:
        if isinstance(e, a.Literal) and not isinstance(e.value, bool):  # 0 is false, other numbers are true
            c = F.lit(bool(e.value))
        return ~c if negated else c

    def _number(self, df: DataFrame, e) -> Column:
        kind = self._kind(df, e)
        if kind is not None and not isinstance(kind, T.NumericType):
            raise QueryError(f"arithmetic needs numbers, {e.name} is {kind.simpleString()}")
        if isinstance(e, a.Literal) and not isinstance(e.value, (int, float)):
            raise QueryError("arithmetic needs numbers")
        return self.expr(df, e).cast("double")

    def _bucket(self, df: DataFrame, e: a.Call) -> Column:
        if len(e.args) != 2 or not isinstance(e.args[0], a.Name):
            raise QueryError("time_bucket(ts, interval)")
        return ops.time_bucket(self._column(df, e.args[0].name), self._width(e.args[1]))

    def _width(self, e) -> int:
        if isinstance(e, a.Literal) and isinstance(e.value, str):
            return buckets.width_micros(e.value)
        if not isinstance(e, a.Interval) or e.nanos % 1000 or not e.nanos:
            raise QueryError("expected an interval of microseconds or more")
        return e.nanos // 1000

    # aggregates
    def _calls(self, e, names: set[str]) -> list[a.Call]:
        if isinstance(e, a.Call):
            if e.fn in names:
                return [e]
            return [c for x in e.args for c in self._calls(x, names)]
        parts = {a.Unary: ("arg",), a.Binary: ("left", "right"), a.In: ("arg",), a.Between: ("arg", "low", "high"), a.IsNull: ("arg",)}
        return [c for f in parts.get(type(e), ()) for c in self._calls(getattr(e, f), names)]

    def _agg(self, df: DataFrame, call: a.Call, alias: str) -> Agg:
        args = call.args
        if call.fn == "count" and (not args or isinstance(args[0], a.Star)):
            return Agg("count", None, alias)
        q = None
        if call.fn in ("percentile", "approx_percentile"):
            if len(args) != 2 or not isinstance(args[1], a.Literal):
                raise QueryError(f"{call.fn}(column, quantile)")
            q = float(args[1].value)
        elif len(args) != 1:
            raise QueryError(f"{call.fn} takes one argument")
        if isinstance(args[0], a.Literal):
            raise QueryError(f"{call.fn} needs a column")
        kind = self._kind(df, args[0])
        if call.fn in ("sum", "avg", "spread", "stddev", "twa", "percentile", "approx_percentile", "p50", "p90", "p99") and kind is not None and not isinstance(kind, T.NumericType):
            raise QueryError(f"{call.fn} needs numbers, {args[0].name} is {kind.simpleString()}")
        approx = call.fn == "approx_percentile"
        return Agg("percentile" if approx else call.fn, self.expr(df, args[0]), alias, q, approx)

    def _after(self, e, made: dict, df: DataFrame, keys: dict):
        """An expression over aggregates: calls are replaced by their columns."""
        if isinstance(e, a.Call) and e in made:
            return a.Name(made[e])
        if e in keys:
            return a.Name(keys[e])
        if isinstance(e, a.Unary):
            return a.Unary(e.op, self._after(e.arg, made, df, keys))
        if isinstance(e, a.Binary):
            return a.Binary(e.op, self._after(e.left, made, df, keys), self._after(e.right, made, df, keys))
        if isinstance(e, a.In):
            return a.In(self._after(e.arg, made, df, keys), e.items, e.negated)
        if isinstance(e, a.Between):
            return a.Between(self._after(e.arg, made, df, keys), e.low, e.high, e.negated)
        if isinstance(e, a.IsNull):
            return a.IsNull(self._after(e.arg, made, df, keys), e.negated)
        return e

    # the query
    def build(self, q: a.Select) -> DataFrame:
        src = self.resolve(q.table)
        df, ts = src.df, src.ts
        if q.where is not None:
            df = self._pruned(df.where(self._truth(df, q.where, self.expr(df, q.where))), src, q.where)
        if q.asof:
            out = self._asof(q, df, src)
        elif q.latest:
            keys = [self._column(df, k) for k in q.partition_by]
            out = self._project(q, ops.latest_on(df, ts, keys, src.tie))
        elif q.sample or q.session or q.state or q.event or self._has_bucket_key(q):
            out = self._windowed(q, df, src)
        elif q.partition_by and any(self._calls(i.expr, ROW_FUNCTIONS | {"interp"}) for i in q.items):
            out = self._project(q, df, src)
        elif q.group_by or q.partition_by or any(self._calls(i.expr, AGGREGATES) for i in q.items):
            out = self._grouped(q, df, src)
        else:
            out = self._project(q, df, src)
            if q.distinct:
                out = out.distinct()
        for name, _ in q.order_by:
            if name not in out.columns and not any(c.lower() == name.lower() for c in out.columns):
                raise QueryError(f"ORDER BY needs an output column, not {name}")
        if q.order_by:
            out = out.orderBy(*[F.col(f"`{self._column(out, n)}`").desc() if down else F.col(f"`{self._column(out, n)}`").asc() for n, down in q.order_by])
        if q.offset:
            out = out.offset(q.offset)
        return out if q.limit is None else out.limit(q.limit)

    def _pruned(self, df: DataFrame, src: Source, where) -> DataFrame:
        """The time bounds of the AND-connected conditions, once more on the partition column."""
        if not src.part:
            return df
        e, todo = where, []
        while isinstance(e, a.Binary) and e.op == "AND":
            todo.append(e.right)
            e = e.left
        for e in [*todo, e]:
            if isinstance(e, a.Between) and not e.negated and isinstance(e.arg, a.Name) and e.arg.name == src.ts:
                bounds = [(">=", e.low), ("<=", e.high)]
            elif isinstance(e, a.Binary) and e.op in ("=", "<", "<=", ">", ">=") and isinstance(e.left, a.Name) and e.left.name == src.ts:
                bounds = [(">=", e.right), ("<=", e.right)] if e.op == "=" else [(e.op, e.right)]
            else:
                continue
            for op, to in bounds:
                if isinstance(to, a.Literal):
                    day = F.date_format(self._literal(to.value, src.df.schema[src.ts].dataType), "yyyyMMddHH")
                    at = F.substring(day, 1, 8) if src.part.endswith("day") else day
                    # Partition names are text of one length, so their order is time's.
                    df = df.where(F.col(src.part) >= at) if op.startswith(">") else df.where(F.col(src.part) <= at)
        return df

    def _has_bucket_key(self, q: a.Select) -> bool:
        return any(isinstance(g, a.Call) and g.fn == "time_bucket" for g in q.group_by)

    def _expanded(self, q: a.Select, df: DataFrame, hidden: Sequence[str] = ()) -> list[a.Item]:
        out = []
        for i in q.items:
            out += [a.Item(a.Name(c), None, c) for c in df.columns if c not in hidden] if isinstance(i.expr, a.Star) else [i]
        return out

    def _project(self, q: a.Select, df: DataFrame, src: Source | None = None) -> DataFrame:
        items = self._expanded(q, df, [src.part] if src and src.part else [])
        calls = [c for i in items for c in self._calls(i.expr, ROW_FUNCTIONS | {"interp"})]
        if not calls:
            return df.select(*[self.expr(df, i.expr).alias(i.alias or i.text) for i in items])
        if src is None or src.ts is None:
            raise QueryError("row functions need a time column")
        keys = [self._column(df, k) for k in q.partition_by]
        interps = [i for i in items if isinstance(i.expr, a.Call) and i.expr.fn == "interp"]
        if interps:
            if len(interps) > 1:
                raise QueryError("one interp a query")
            e = interps[0].expr
            if len(e.args) != 2 or not isinstance(e.args[0], a.Name):
                raise QueryError("interp(column, interval)")
            name = interps[0].alias or interps[0].text
            out = ops.interp(df, src.ts, self._column(df, e.args[0].name), self._width(e.args[1]), "__interp", keys, src.tie)
            return out.select(*[F.col("__interp").alias(name) if i is interps[0] else self.expr(out, i.expr).alias(i.alias or i.text) for i in items])
        made, plain, sums, before = {}, {}, {}, 1
        for n, c in enumerate(dict.fromkeys(calls)):
            if not c.args or not isinstance(c.args[0], a.Name):
                raise QueryError(f"{c.fn} needs a column")
            col, to = self._column(df, c.args[0].name), f"__f{n}"
            count = c.args[1].value if len(c.args) > 1 and isinstance(c.args[1], a.Literal) else None
            made[c] = to
            if c.fn == "csum":
                sums[to] = col
            elif c.fn in ("mavg", "lag"):
                if c.fn == "mavg" and not isinstance(count, int):
                    raise QueryError("mavg(column, rows)")
                plain[to] = (row_ops.mavg_of if c.fn == "mavg" else row_ops.lag_of)(col, count or 1)
                before = max(before, count or 1)
            elif c.fn == "diff":
                plain[to] = row_ops.diff_of(col)
            else:
                if len(c.args) > 1 and c.args[1:] != (a.Literal("quotient"),):
                    raise QueryError("derivative(column) or derivative(column, 'quotient')")
                plain[to] = row_ops.derivative_of(col, src.ts, len(c.args) > 1)
        df = row_ops.row_functions(df, src.ts, plain, before, keys, src.tie, sums=sums)
        return df.select(*[self.expr(df, self._after(i.expr, made, df, {})).alias(i.alias or i.text) for i in items])

    def _grouped(self, q: a.Select, df: DataFrame, src: Source) -> DataFrame:
        keys = [self._column(df, g.name) for g in q.group_by if isinstance(g, a.Name)]
        if len(keys) != len(q.group_by):
            raise QueryError("GROUP BY takes columns or time_bucket")
        keys += [self._column(df, k) for k in q.partition_by if self._column(df, k) not in keys]
        wanted = [*[i.expr for i in q.items], *([q.having] if q.having is not None else [])]
        calls = list(dict.fromkeys(c for e in wanted for c in self._calls(e, AGGREGATES)))
        made = {c: f"__g{n}" for n, c in enumerate(calls)}
        if not calls:
            out = df.select(*keys).distinct()
        else:
            out = aggregate(df, [self._agg(df, c, to) for c, to in made.items()], keys, src.ts, src.tie)
        if q.having is not None:
            named = {a.Name(i.alias): self._after(i.expr, made, out, {}) for i in q.items if i.alias}
            cond = self._after(self._substituted(q.having, named), made, out, {})
            out = out.where(self._truth(out, cond, self.expr(out, cond)))
        items = [a.Item(a.Name(k), None, k) for k in keys] if any(isinstance(i.expr, a.Star) for i in q.items) else q.items
        shown = [a.Item(a.Name(k), None, k) for k in q.partition_by if not any(isinstance(i.expr, a.Name) and i.expr.name == k for i in items)]
        return out.select(*[self.expr(out, self._after(i.expr, made, out, {})).alias(i.alias or i.text) for i in [*shown, *items]])

    def _substituted(self, e, by: dict):
        if e in by:
            return by[e]
        if isinstance(e, a.Unary):
            return a.Unary(e.op, self._substituted(e.arg, by))
        if isinstance(e, a.Binary):
            return a.Binary(e.op, self._substituted(e.left, by), self._substituted(e.right, by))
        if isinstance(e, (a.In, a.IsNull)):
            return type(e)(self._substituted(e.arg, by), *([e.items] if isinstance(e, a.In) else []), e.negated)
        if isinstance(e, a.Between):
            return a.Between(self._substituted(e.arg, by), e.low, e.high, e.negated)
        return e

    def _windowed(self, q: a.Select, df: DataFrame, src: Source) -> DataFrame:
        if src.ts is None:
            raise QueryError("windows need a time column")
        keys = [self._column(df, k) for k in q.partition_by]
        bucket = next((g for g in q.group_by if isinstance(g, a.Call) and g.fn == "time_bucket"), None)
        keys += [self._column(df, g.name) for g in q.group_by if isinstance(g, a.Name)]
        calls = list(dict.fromkeys(c for i in q.items for c in self._calls(i.expr, AGGREGATES)))
        if not calls:
            raise QueryError("a window needs an aggregate")
        made = {c: f"__g{n}" for n, c in enumerate(calls)}
        aggs = [self._agg(df, c, to) for c, to in made.items()]
        if q.sample or bucket:
            width = self._width(bucket.args[1]) if bucket else self._width(q.sample)
            out = ops.sample_by(df, src.ts, width, aggs, keys, src.tie, "window_start", q.fill)
            out = out.withColumn("window_end", F.timestamp_micros(F.unix_micros(F.col("window_start").cast("timestamp")) + width).cast("timestamp_ntz"))
        elif q.session:
            out = ops.session(df, src.ts, self._width(q.session), aggs, keys, src.tie)
        elif q.state:
            out = ops.state_window(df, src.ts, self._column(df, q.state), aggs, keys, src.tie)
        else:
            start, end = (self._truth(df, e, self.expr(df, e)) for e in q.event)
            out = ops.event_window(df, src.ts, start, end, aggs, keys, src.tie)
        starts = {c: "window_start" for i in q.items for c in self._calls(i.expr, {"time_bucket"})} | {a.Name(src.ts): "window_start"}
        items = []
        for k in keys:
            if not any(isinstance(i.expr, a.Name) and i.expr.name == k for i in q.items):
                items.append(a.Item(a.Name(k), None, k))
        if not any(c in starts for i in q.items for c in [i.expr]):
            items.append(a.Item(a.Name("window_start"), None, "window_start"))
        out = out.select(*[self.expr(out, self._after(i.expr, made, out, starts)).alias(i.alias or i.text) for i in [*items, *q.items]])
        return out

    def _asof(self, q: a.Select, df: DataFrame, src: Source) -> DataFrame:
        other = self.resolve(q.asof)
        drop = lambda d, s: d.drop(s.part) if s.part else d
        left, right = drop(df, src), drop(other.df, other)
        on = [(self._column(left, x), self._column(right, y)) for x, y in q.asof_on]
        return self._project(q, ops.asof_join(left, right, src.ts, other.ts, on, other.tie))
