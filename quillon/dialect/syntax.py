"""The syntax tree, as the parser makes it: names are not resolved yet."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any


@dataclass(frozen=True)
class Literal:
    value: Any  # None, bool, int, float or str


@dataclass(frozen=True)
class Name:
    name: str
    table: str | None = None


@dataclass(frozen=True)
class Unary:
    op: str  # + - not
    operand: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Between:
    operand: Any
    low: Any
    high: Any
    symmetric: bool = False


@dataclass(frozen=True)
class Is:
    operand: Any
    what: str  # null true false unknown


@dataclass(frozen=True)
class InList:
    operand: Any
    items: tuple


@dataclass(frozen=True)
class InQuery:
    operand: Any
    query: Any


@dataclass(frozen=True)
class Exists:
    query: Any


@dataclass(frozen=True)
class Scalar:
    """A query in place of a value."""

    query: Any


@dataclass(frozen=True)
class Over:
    """A call over a window. frame: (rows or range, start, end), each end a number of rows or None."""

    call: Any
    partition: tuple = ()
    order: tuple = ()
    frame: Any = None


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    star: bool = False
    distinct: bool = False


@dataclass(frozen=True)
class Case:
    branches: tuple  # of (condition, value)
    default: Any = None


@dataclass(frozen=True)
class Cast:
    operand: Any
    type: str


@dataclass(frozen=True)
class Star:
    table: str | None = None


@dataclass(frozen=True)
class Item:
    expr: Any
    alias: str | None = None


@dataclass(frozen=True)
class Order:
    expr: Any
    descending: bool = False
    nulls_first: bool | None = None


@dataclass(frozen=True)
class TableName:
    name: str


@dataclass(frozen=True)
class Values:
    rows: tuple


@dataclass(frozen=True)
class Aliased:
    source: Any  # TableName, Select, Values, SetOperation or Join
    alias: str | None = None
    columns: tuple = ()


@dataclass(frozen=True)
class Join:
    left: Any
    right: Any
    kind: str = "inner"
    on: Any = None
    using: tuple | None = None  # of column names; empty for NATURAL


@dataclass(frozen=True)
class Select:
    items: tuple
    sources: tuple = ()
    where: Any = None
    group: tuple = ()
    having: Any = None
    distinct: bool = False
    order: tuple = ()
    limit: int | None = None
    offset: int | None = None
    with_: tuple = ()  # of (name, columns, query)
    distinct_on: tuple = ()


@dataclass(frozen=True)
class SetOperation:
    op: str  # union intersect except
    all: bool
    left: Any
    right: Any
    order: tuple = ()
    limit: int | None = None
    offset: int | None = None
    with_: tuple = ()


@dataclass(frozen=True)
class Insert:
    table: str
    alias: str | None
    columns: tuple
    source: Any
    returning: tuple = ()


@dataclass(frozen=True)
class Update:
    table: str
    alias: str | None
    changes: tuple  # of (column, expression)
    sources: tuple = ()
    where: Any = None
    returning: tuple = ()


@dataclass(frozen=True)
class Delete:
    table: str
    alias: str | None
    sources: tuple = ()
    where: Any = None
    returning: tuple = ()


@dataclass(frozen=True)
class Explain:
    statement: Any


@dataclass(frozen=True)
class PrimaryKey:
    columns: tuple
    name: str | None = None


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple
    table: str
    targets: tuple
    name: str | None = None


@dataclass(frozen=True)
class Check:
    condition: Any
    name: str | None = None


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    nullable: bool = True
    serial: bool = False
    default: Any = None
    constraints: tuple = field(default=())


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple
    constraints: tuple = ()


@dataclass(frozen=True)
class CreateSequence:
    name: str
    type: str = "bigint"


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    method: str
    keys: tuple  # of Order
    unique: bool = False
    where: Any = None


@dataclass(frozen=True)
class AddConstraint:
    table: str
    constraint: Any


def names(node) -> list[str]:
    """The columns that a part of the tree names."""
    if isinstance(node, Name):
        return [node.name]
    if isinstance(node, tuple):
        return [n for part in node for n in names(part)]
    if is_dataclass(node):
        return [n for f in fields(node) for n in names(getattr(node, f.name))]
    return []
