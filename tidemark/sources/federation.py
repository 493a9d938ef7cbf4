"""Queries over the stores of several clusters: tables are routed by pattern, and lost stores are counted, not fatal."""

from __future__ import annotations

from collections.abc import Sequence
from fnmatch import fnmatchcase

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from ..operators import stable
from ..plans import ast as a
from ..plans.builder import Builder, Source
from ..plans.lexer import QueryError
from ..plans.parser import parse
from .engine import Engine


class Federation:
    """Each table name reads the union of that table in all stores whose pattern fits (``cpu``, ``cpu*``, ``*``).

    A query is planned once over the union, so averages, percentiles and windows are those of all rows
    together; nothing is merged from rounded partial results.
    """

    def __init__(self, spark: SparkSession, routes: Sequence[tuple[str, str]] = ()):
        self.spark, self.routes = spark, list(routes)

    def add(self, pattern: str, root: str) -> None:
        self.routes.append((pattern, root))

    def source(self, name: str) -> tuple[Source, list[str]]:
        """The union of a table's rows, and the roots where it could not be opened. An error if it is nowhere."""
        found: list[Source] = []
        missed: list[str] = []
        roots = [r for p, r in self.routes if fnmatchcase(name, p)]
        for root in dict.fromkeys(roots):
            try:
                found.append(Engine(self.spark, root).table(name))
            except (QueryError, OSError, Py4JError, PySparkException):
                missed.append(root)
        if not found:
            raise QueryError(f"no store has {name}")
        if len({s.ts for s in found}) > 1:
            raise QueryError(f"{name} has different time columns")
        part = found[0].part if len({s.part for s in found}) == 1 else None
        frames = [s.df if part or not s.part else s.df.drop(s.part) for s in found]
        return Source(stable.federated(frames), found[0].ts, (), part), missed

    def sql(self, text: str) -> tuple[DataFrame, list[str]]:
        """(rows of a SELECT, roots that were missed)."""
        s = parse(text)
        if not isinstance(s, a.Select):
            raise QueryError("only SELECT runs over several stores")
        missed: list[str] = []

        def resolve(name: str) -> Source:
            source, lost = self.source(name)
            missed.extend(x for x in lost if x not in missed)
            return source

        out = Builder(resolve).build(s)
        return out.drop(*[c for c in out.columns if c.startswith("_part_")]), missed
