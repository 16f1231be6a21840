"""Expressions with their names resolved and their types known."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql.types import DataType


@dataclass(frozen=True)
class Col:
    uid: str
    type: DataType


@dataclass(frozen=True)
class Const:
    value: Any
    type: DataType


@dataclass(frozen=True)
class Op:
    """op: an operator, "cast", "case", "call:name" or "nextval:name"."""

    op: str
    args: tuple
    type: DataType


@dataclass(frozen=True)
class Agg:
    name: str
    args: tuple
    distinct: bool
    type: DataType


@dataclass(frozen=True)
class Outer:
    """A column of a query around this one."""

    uid: str
    type: DataType


@dataclass(frozen=True)
class Sub:
    """A subquery as an expression. kind: "in" (of one argument), "exists" or "scalar"."""

    kind: str
    df: Any
    args: tuple
    type: DataType


@dataclass(frozen=True)
class Win:
    """A function over a window: args, then counts[0] keys to part by, then the keys to order by."""

    name: str
    args: tuple
    counts: tuple  # of own arguments, of parting keys
    order: tuple  # (descending, nulls first) of each ordering key
    frame: Any
    distinct: bool
    type: DataType


def parts(expr):
    """expr and all below it."""
    yield expr
    for arg in getattr(expr, "args", ()):
        yield from parts(arg)


def aggregates(*exprs) -> list[Agg]:
    """Distinct aggregates, in order of appearance."""
    return list(dict.fromkeys(p for e in exprs for p in parts(e) if isinstance(p, Agg)))


def replaced(expr, known: dict):
    """expr with every part that known has exchanged, the largest parts first."""
    if expr in known:
        return known[expr]
    if isinstance(expr, (Op, Agg, Sub, Win)):
        return replace(expr, args=tuple(replaced(a, known) for a in expr.args))
    return expr


def windows(*exprs) -> list[Win]:
    """Distinct functions over windows, in order of appearance."""
    return list(dict.fromkeys(p for e in exprs for p in parts(e) if isinstance(p, Win)))


def columns(expr) -> list[Col]:
    return [p for p in parts(expr) if isinstance(p, Col)]
