"""A subset of metric expressions, planned as DataFrames.

selector: ``m{a="x", b!="y"}``; ``rate`` and ``irate(m[d])`` per series; ``avg/sum/min/max/count_over_time(m[d])`` per
series and bucket of d; ``sum/avg/count/min/max [by (labels) | without (labels)] (expr)`` over instants of what is inside;
``m offset 5m`` shows what was so much earlier; ``expr + - * / number`` on either side.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import operators as ops
from ..functions.aggregates import Agg, aggregate
from ..operators.buckets import width_micros
from ..order import micros
from .lexer import QueryError

AGGREGATES = ("sum", "avg", "count", "min", "max")
OVER_TIME = {f"{f}_over_time": f for f in AGGREGATES}
_SELECTOR = re.compile(r"\s*([A-Za-z_:][A-Za-z0-9_:]*)\s*(?:\{([^}]*)\})?\s*(?:\[(\w+)\])?\s*(?:offset\s+(-?\w+))?\s*$")
_NUMBER = re.compile(r"\s*[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?\s*")
_LABEL = re.compile(r'\s*([A-Za-z_]\w*)\s*(=~|!~|!=|=)\s*"((?:[^"\\]|\\.)*)"\s*(?:,|$)')


@dataclass(frozen=True)
class Selector:
    metric: str
    labels: tuple[tuple[str, str, str], ...]
    width: str | None
    offset: str | None = None


def selector(text: str) -> Selector:
    m = _SELECTOR.match(text)
    if not m:
        raise QueryError(f"not a selector: {text.strip()}")
    labels, at, inside = [], 0, m[2] or ""
    while inside[at:].strip():
        found = _LABEL.match(inside, at)
        if not found:
            raise QueryError(f"not a label matcher: {inside[at:]}")
        labels.append((found[1], found[2], re.sub(r"\\(.)", r"\1", found[3])))
        at = found.end()
    return Selector(m[1], tuple(labels), m[3], m[4])


def _closed(text: str, at: int) -> tuple[str, str]:
    """What stands before and after the parenthesis that closes the one before ``at``; quoted text is passed over."""
    depth = 1
    for m in re.finditer(r'"(?:[^"\\]|\\.)*"|[()]', text[at:]):
        depth += {"(": 1, ")": -1}.get(m[0], 0)
        if not depth:
            return text[at : at + m.start()], text[at + m.end() :]
    raise QueryError("a parenthesis is open")


def _split(text: str) -> tuple[str, str, str] | None:
    """Both sides of the operator that binds least, the last of its kind; signs of numbers and offsets are none."""
    depth, found = 0, {}
    for m in re.finditer(r'"(?:[^"\\]|\\.)*"|[(){}\[\]]|[-+*/]', text):
        depth += {"(": 1, "{": 1, "[": 1, ")": -1, "}": -1, "]": -1}.get(m[0], 0)
        before = text[: m.start()].rstrip()
        if depth == 0 and m[0] in "-+*/" and before and before[-1] not in "-+*/" and not re.search(r"(?:\boffset|\d[eE])$", before):
            found["+-" if m[0] in "+-" else "*/"] = m
    m = found.get("+-") or found.get("*/")
    return (text[: m.start()], m[0], text[m.end() :]) if m else None


class PromQL:
    """resolve gives (DataFrame, time column) of a metric; value is the measured column, other text columns are labels."""

    def __init__(self, resolve: Callable[[str], tuple[DataFrame, str]], value: str = "value"):
        self.resolve, self.value = resolve, value

    def _rows(self, s: Selector) -> tuple[DataFrame, str, list[str]]:
        df, ts = self.resolve(s.metric)
        labels = [c for c, t in df.dtypes if t == "string"]
        for name, op, text in s.labels:
            if name not in df.columns:
                raise QueryError(f"unknown label {name}")
            c = F.col(name).cast("string")
            df = df.where({"=": c == text, "!=": c != text, "=~": c.rlike(f"^(?:{text})$"), "!~": ~c.rlike(f"^(?:{text})$")}[op])
        at = F.col(ts)
        if s.offset:
            later = width_micros(s.offset.lstrip("-")) * (-1 if s.offset.startswith("-") else 1)
            at = F.timestamp_micros(micros(ts) + later).cast(df.schema[ts].dataType)
        return df.select(at.alias("ts"), *labels, F.col(self.value).cast("double").alias("value")), "ts", labels

    def plan(self, text: str) -> tuple[DataFrame, list[str]]:
        """(ts, labels, value) rows and the labels."""
        text = text.strip()
        if parts := _split(text):
            left, op, right = parts
            scalar = [bool(_NUMBER.fullmatch(x)) for x in (left, right)]
            if scalar not in ([True, False], [False, True]):
                raise QueryError("arithmetic takes an expression and a number")
            inner, labels = self.plan(right if scalar[0] else left)
            a, b = (F.lit(float(x)) if number else F.col("value") for x, number in zip((left, right), scalar, strict=True))
            return inner.withColumn("value", {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[op]), labels
        if text.startswith("(") and not (inside := _closed(text, 1))[1].strip():
            return self.plan(inside[0])
        m = re.match(r"(sum|avg|count|min|max)\s*(?:(by|without)\s*\(([^)]*)\)\s*)?\(", text)
        if m:
            body, rest = _closed(text, m.end())
            after = re.fullmatch(r"\s*(?:(by|without)\s*\(([^)]*)\))?\s*", rest)
            if not after or (after[1] is not None and m[2] is not None):
                raise QueryError(f"unexpected text: {rest.strip()}")
            inner, labels = self.plan(body)
            given, which = (m[3], m[2]) if m[2] is not None else (after[2], after[1])
            by = [x.strip() for x in (given or "").split(",") if x.strip()]
            if which == "without":
                if gone := [x for x in by if x not in labels]:
                    raise QueryError(f"unknown label {gone[0]}")
                by = [x for x in labels if x not in by]
            if missing := [x for x in by if x not in labels]:
                raise QueryError(f"unknown label {missing[0]}")
            instants = bool(re.match(r"\w+\s*(by\b|\()", body.strip()))  # of a rate or window: at every instant; of a bare metric: over all rows
            keys = [*by, *(["ts"] if instants else [])]
            out = aggregate(inner, [Agg(m[1], "value", "value")], keys)
            return out, by
        m = re.match(r"(\w+)\s*\((.*)\)$", text, re.S)
        if m:
            s = selector(m[2])
            rows, ts, labels = self._rows(s)
            if s.width is None:
                raise QueryError(f"{m[1]} needs a range")
            if m[1] in ("rate", "irate"):
                out = ops.derivative(rows, ts, "value", "rate", labels)
                return out.select(ts, *labels, F.col("rate").alias("value")).where("value is not null"), labels
            if m[1] in OVER_TIME:
                out = ops.sample_by(rows, ts, s.width, [Agg(OVER_TIME[m[1]], "value", "value")], labels, bucket="ts")
                return out.select("ts", *labels, F.col("value").cast("double").alias("value")), labels
            raise QueryError(f"unknown function {m[1]}")
        s = selector(text)
        if s.width:
            raise QueryError("a range needs a function")
        rows, _, labels = self._rows(s)
        return rows, labels

    def query(self, text: str) -> DataFrame:
        out, _ = self.plan(text)
        return out.orderBy("ts") if "ts" in out.columns else out

    def matrix(self, text: str) -> DataFrame:
        """One row a series: metric (labels as JSON) and values, [[seconds, "value"], …] as JSON."""
        out, labels = self.plan(text)
        if "ts" not in out.columns:
            raise QueryError("a matrix needs instants")
        point = F.struct(F.col("ts").alias("t"), F.format_string("[%.3f,\"%s\"]", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6), F.col("value").cast("string")).alias("p"))
        series = out.groupBy(*labels).agg(F.array_sort(F.collect_list(point)).alias("v"))
        metric = F.to_json(F.struct(*labels)) if labels else F.lit("{}")
        return series.select(metric.alias("metric"), F.concat(F.lit("["), F.array_join(F.transform("v", lambda x: x["p"]), ","), F.lit("]")).alias("values"))
