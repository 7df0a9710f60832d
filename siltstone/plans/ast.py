"""The query model: a filter tree, aggregates, and what a query asks for."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from enum import Enum


class Kind(Enum):
    INTEGER = "integer"
    FLOAT = "float"
    BOOLEAN = "boolean"
    STRING = "string"
    DATETIME = "datetime"


@dataclass(frozen=True)
class Literal:
    kind: Kind
    value: int | float | bool | str | datetime


@dataclass(frozen=True)
class Comparison:
    column: str
    op: str
    literal: Literal


@dataclass(frozen=True)
class And:
    left: Filter
    right: Filter


@dataclass(frozen=True)
class Or:
    left: Filter
    right: Filter


@dataclass(frozen=True)
class Not:
    of: Filter


Filter = Comparison | And | Or | Not


@dataclass(frozen=True)
class Aggregate:
    op: str
    column: str

    @property
    def name(self) -> str:
        return f"{self.op}({self.column})"


class Feature(Enum):
    GROUP = "group"
    BLOOM = "bloom"
    ROW = "row"
    COLUMN = "column"
    AGGR = "aggr"


#: Named modes build on each other; the bloom filter is a feature of its own.
MODES: dict[str, frozenset[Feature]] = {
    "none": frozenset(),
    "group": frozenset({Feature.GROUP}),
    "row": frozenset({Feature.GROUP, Feature.ROW}),
    "column": frozenset({Feature.GROUP, Feature.ROW, Feature.COLUMN}),
    "aggr": frozenset({Feature.GROUP, Feature.ROW, Feature.COLUMN, Feature.AGGR}),
}


@dataclass(frozen=True)
class Query:
    """``select`` None: all columns. ``filter`` None: all rows."""

    filter: Filter | None = None
    select: tuple[str, ...] | None = None
    aggregates: tuple[Aggregate, ...] = field(default_factory=tuple)


def columns_of(f: Filter | None) -> list[str]:
    """Columns a filter reads, each once, in order of appearance."""
    found: dict[str, None] = {}
    todo: list[Filter] = [] if f is None else [f]
    while todo:
        node = todo.pop()
        match node:
            case Comparison(column=c):
                found.setdefault(c)
            case Not(of=inner):
                todo.append(inner)
            case And(left=a, right=b) | Or(left=a, right=b):
                todo += [b, a]
    return list(found)


def columns_of_aggregates(aggregates: tuple[Aggregate, ...]) -> list[str]:
    return list(dict.fromkeys(a.column for a in aggregates))
