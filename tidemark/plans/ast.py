"""Statements and expressions."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class Interval:
    nanos: int
    text: str


@dataclass(frozen=True)
class Star:
    pass


@dataclass(frozen=True)
class Call:
    fn: str
    args: tuple


@dataclass(frozen=True)
class Unary:
    op: str
    arg: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class In:
    arg: object
    items: tuple
    negated: bool = False


@dataclass(frozen=True)
class Between:
    arg: object
    low: object
    high: object
    negated: bool = False


@dataclass(frozen=True)
class IsNull:
    arg: object
    negated: bool = False


@dataclass(frozen=True)
class Item:
    expr: object
    alias: str | None
    text: str


@dataclass
class Select:
    items: list[Item]
    table: str
    distinct: bool = False
    asof: str | None = None
    asof_on: list[tuple[str, str]] = field(default_factory=list)
    where: object = None
    partition_by: list[str] = field(default_factory=list)
    sample: Interval | None = None
    fill: object = None
    session: Interval | None = None
    state: str | None = None
    event: tuple | None = None
    latest: str | None = None
    group_by: list = field(default_factory=list)
    having: object = None
    order_by: list[tuple[str, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int | None = None


@dataclass
class Statement:
    """Everything but SELECT: a verb and its parts."""

    verb: str
    args: dict = field(default_factory=dict)
