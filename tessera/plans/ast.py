"""Statements of the query language, as data."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.filters import Filter


@dataclass(frozen=True)
class Node:
    var: str
    filter: Filter | None = None
    payload: dict | None = None  # in CREATE


@dataclass(frozen=True)
class Edge:
    labels: tuple[str, ...] = ()
    direction: str = "out"  # out, in, both
    hops: tuple[int, int] | None = None
    weight: float = 1.0


@dataclass(frozen=True)
class Path:
    nodes: tuple[Node, ...]
    edges: tuple[Edge, ...] = ()


@dataclass(frozen=True)
class Prop:
    var: str
    key: str | None = None  # None: the node itself


@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class Compare:
    left: Prop
    op: str
    right: Prop | Literal


@dataclass(frozen=True)
class Matches:
    var: str | None
    filter: Filter


@dataclass(frozen=True)
class Bool:
    op: str  # and, or, not
    parts: tuple


@dataclass(frozen=True)
class Item:
    expr: Prop
    func: str | None = None
    distinct: bool = False
    alias: str | None = None


@dataclass(frozen=True)
class Search:
    vector: tuple[float, ...]
    top: int
    expand: Edge | None = None


@dataclass(frozen=True)
class Query:
    entry: Filter | Path | Search
    where: object | None = None
    items: tuple[Item, ...] | None = None  # None: *
    order: tuple[tuple[Prop | Literal, bool], ...] = ()
    limit: int | None = None
    offset: int = 0
    explain: bool = False
    optional: bool = False
    source: str = field(default="", compare=False)


@dataclass(frozen=True)
class Mutation:
    match: Query | None
    create: tuple[Path, ...] = ()
    assign: tuple[tuple[Prop, object], ...] = ()
    delete: tuple[str, ...] = ()
    detach: bool = False
