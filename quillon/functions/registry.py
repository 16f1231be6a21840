"""Scalar and aggregate functions: a name, argument types, a result type, a Column builder.

More can be registered. A builder gets Columns and returns one, so a built-in function, a
Pandas UDF and a registered UDAF serve alike.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon import types
from quillon.errors import NameProblem, TypeProblem


@dataclass(frozen=True)
class Function:
    """params: a type, a tuple of types that fit, or None for any, for each argument."""

    name: str
    params: tuple
    returns: T.DataType | Callable
    build: Callable
    least: int | None = None  # arguments needed, all by default
    repeat: bool = False  # whether the last parameter may be repeated
    #: Of aggregates: "same" if repeats don't matter, else SQL over distinct columns, or None if there is none.
    distinct: str | None = None

    def result(self, kinds: list):
        need = len(self.params) if self.least is None else self.least
        if len(kinds) < need or (len(kinds) > len(self.params) and not self.repeat):
            raise TypeProblem(f"{self.name}() takes {len(self.params)} arguments, not {len(kinds)}")
        for i, kind in enumerate(kinds):
            wanted = self.params[min(i, len(self.params) - 1)]
            if wanted is None or types.is_null(kind):
                continue
            if not any(types.assignable(w, kind) for w in (wanted if isinstance(wanted, tuple) else (wanted,))):
                raise TypeProblem(f"{self.name}() doesn't take {types.name_of(kind)}")
        return self.returns(kinds) if callable(self.returns) else self.returns


class Registry:
    def __init__(self, known=()):
        self.known = {f.name: f for f in known}

    def register(self, name: str, params, returns, build, **more):
        self.known[name.lower()] = Function(name.lower(), tuple(params), returns, build, **more)

    def get(self, name: str) -> Function:
        if name not in self.known:
            raise NameProblem(f"no function {name}()")
        return self.known[name]

    def __contains__(self, name: str) -> bool:
        return name in self.known


NUMBER = (types.DOUBLE, types.NUMERIC)


def _same(kinds):
    return kinds[0]


def _shared(kinds):
    found = kinds[0]
    for kind in kinds[1:]:
        found = types.common(found, kind, "mix")
    return found


def _summed(kinds):
    kind = kinds[0]
    if types.is_whole(kind) or types.is_null(kind):
        return types.BIGINT
    return types.NUMERIC if isinstance(kind, T.DecimalType) else types.DOUBLE


#: No value at all gives null, as an aggregate does.
JOINED = "array_join(array_sort(nullif(collect_set({0}), array())), first({1}))"


def _joined(x, between):
    values = F.nullif(F.collect_list(x), F.array().cast("array<string>"))
    return F.call_function("array_join", F.array_sort(values), F.first(between))


def scalars() -> Registry:
    text, whole = types.TEXT, types.BIGINT
    return Registry([
        # length counts bytes
        Function("length", (text,), whole, lambda x: F.octet_length(x).cast("bigint")),
        Function("now", (), types.BY_NAME["timestamp with time zone"], F.current_timestamp),
        Function("char_length", (text,), types.INTEGER, F.length),
        Function("lower", (text,), text, F.lower),
        Function("upper", (text,), text, F.upper),
        Function("trim", (text,), text, F.trim),
        Function("substr", (text, types.INTEGER, types.INTEGER), text, lambda x, a, n=None: F.substring(x, a, n if n is not None else F.length(x)), least=2),
        Function("abs", (NUMBER,), _same, F.abs),
        Function("round", (NUMBER, types.INTEGER), _same, lambda x, n=None: F.round(x, n if n is not None else F.lit(0)), least=1),
        Function("floor", (NUMBER,), types.DOUBLE, lambda x: F.floor(x).cast("double")),
        Function("ceil", (NUMBER,), types.DOUBLE, lambda x: F.ceil(x).cast("double")),
        Function("coalesce", (None,), _shared, F.coalesce, repeat=True),
        Function("nullif", (None, None), _same, F.nullif),
        Function("greatest", (None, None), _shared, F.greatest, repeat=True),
        Function("least", (None, None), _shared, F.least, repeat=True),
    ])


def aggregates() -> Registry:
    whole, double = types.BIGINT, types.DOUBLE
    return Registry([
        Function("count", (None,), whole, F.count, distinct="count(DISTINCT {0})"),
        Function("sum", (NUMBER,), _summed, F.sum, distinct="sum(DISTINCT {0})"),
        Function("min", (None,), _same, F.min, distinct="same"),
        Function("max", (None,), _same, F.max, distinct="same"),
        Function("avg", (NUMBER,), double, F.avg, distinct="avg(DISTINCT {0})"),
        Function("stddev", (NUMBER,), double, F.stddev, distinct="stddev(DISTINCT {0})"),
        Function("bool_and", (types.BOOLEAN,), types.BOOLEAN, F.bool_and, distinct="same"),
        Function("bool_or", (types.BOOLEAN,), types.BOOLEAN, F.bool_or, distinct="same"),
        # in the order of the texts, as SQL leaves it open
        Function("string_agg", (types.TEXT, types.TEXT), types.TEXT, _joined, distinct=JOINED),
    ])


def rankings() -> Registry:
    """Functions that need a window."""
    whole, double, number = types.BIGINT, types.DOUBLE, types.INTEGER
    plain = lambda value: lambda *_: value()
    moved = lambda f: lambda x, n=1, default=None: f(x, n, default)
    return Registry([
        Function("row_number", (), whole, plain(F.row_number)),
        Function("rank", (), whole, plain(F.rank)),
        Function("dense_rank", (), whole, plain(F.dense_rank)),
        Function("percent_rank", (), double, plain(F.percent_rank)),
        Function("cume_dist", (), double, plain(F.cume_dist)),
        Function("ntile", (number,), number, F.ntile),
        Function("lag", (None, number, None), _same, moved(F.lag), least=1),
        Function("lead", (None, number, None), _same, moved(F.lead), least=1),
        Function("first_value", (None,), _same, F.first),
        Function("last_value", (None,), _same, F.last),
        Function("nth_value", (None, number), _same, F.nth_value),
    ])
