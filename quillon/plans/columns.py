"""Bound expressions to Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from quillon import types
from quillon.errors import TypeProblem
from quillon.functions.registry import rankings
from quillon.plans.bound import Agg, Col, Const, Op, Outer, Sub, Win

RANKINGS = rankings()


def ordering(column: Column, descending: bool, nulls_first: bool) -> Column:
    if descending:
        return column.desc_nulls_first() if nulls_first else column.desc_nulls_last()
    return column.asc_nulls_first() if nulls_first else column.asc_nulls_last()


class Columns:
    def __init__(self, functions, aggregates):
        self.functions, self.aggregates = functions, aggregates

    def make(self, expr) -> Column:
        match expr:
            case Col(uid, _):
                return F.col(uid)
            case Const(value, kind):
                return F.lit(value).cast(kind)
            case Agg():
                return self.aggregate(expr)
            case Outer(uid, _):
                return F.col(uid).outer()
            case Sub("exists", df):
                return df.exists()
            case Sub("scalar", df):
                return df.scalar()
            case Sub("in", df, args):
                return self.make(args[0]).isin(df)
            case Win():
                return self.window(expr)
            case Op(op, args, kind):
                if op.startswith("call:"):
                    return self.functions.get(op[5:]).build(*map(self.make, args)).cast(kind)
                return self.operator(op, [self.make(a) for a in args], kind)
        raise TypeError(expr)

    def operator(self, op: str, args: list[Column], kind) -> Column:
        match op, args:
            case "cast", [x]:
                return x.cast(kind)
            case "case", [*pairs, default]:
                found = F.when(pairs[0], pairs[1])
                for condition, value in zip(pairs[2::2], pairs[3::2]):
                    found = found.when(condition, value)
                return found.otherwise(default)
            case "not", [x]:
                return ~x
            case "is null", [x]:
                return x.isNull()
            case "same", [x, y]:
                return x.eqNullSafe(y)
            case "-", [x]:
                return (-x).cast(kind)
            case "+", [x]:
                return x
            case "/", [x, y] if types.is_whole(kind):
                return F.call_function("div", x, y).cast(kind)
            case ("+" | "-" | "*" | "/"), [x, y]:
                made = {"+": x + y, "-": x - y, "*": x * y, "/": x / y}[op]
                return made.cast(kind)
            case "||", [x, y]:
                return F.concat(x, y)
            case "like", [x, y]:
                return F.like(x, y)
            case "ilike", [x, y]:
                return F.ilike(x, y)
            case "and", [x, y]:
                return x & y
            case "or", [x, y]:
                return x | y
            case "in list", [x, *items]:
                return x.isin(items)
            case "=", [x, y]:
                return x == y
            case "<>", [x, y]:
                return x != y
            case "<", [x, y]:
                return x < y
            case "<=", [x, y]:
                return x <= y
            case ">", [x, y]:
                return x > y
            case ">=", [x, y]:
                return x >= y
        if op.startswith("nextval:"):
            raise TypeProblem("nextval() stands in select lists, inserted values and SET without FROM only")
        raise TypeError(op)

    def window(self, win: Win) -> Column:
        own, parted = win.counts
        args, keys, order = win.args[:own], win.args[own : own + parted], win.args[own + parted :]
        spec = Window.partitionBy(*map(self.make, keys))
        if order:
            spec = spec.orderBy(*[ordering(self.make(e), *flags) for e, flags in zip(order, win.order)])
        if win.frame:
            unit, start, end = win.frame
            far = {float("-inf"): Window.unboundedPreceding, float("inf"): Window.unboundedFollowing}
            between = spec.rowsBetween if unit == "rows" else spec.rangeBetween
            spec = between(far.get(start, start), far.get(end, end))
        if win.name in RANKINGS:
            # offsets, counts and defaults are literals
            plain = [a.value if isinstance(a, Const) and i else self.make(a) for i, a in enumerate(args)]
            if win.name == "ntile":
                plain = [args[0].value]
            return RANKINGS.get(win.name).build(*plain).over(spec).cast(win.type)
        if win.distinct:
            raise TypeProblem(f"{win.name}() over a window doesn't take DISTINCT")
        return self.aggregates.get(win.name).build(*map(self.make, args)).over(spec).cast(win.type)

    def aggregate(self, agg: Agg) -> Column:
        function = self.aggregates.get(agg.name)
        args = [self.make(a) for a in agg.args]
        if not agg.distinct or function.distinct == "same":
            return function.build(*args).cast(agg.type)
        if agg.name == "count":
            return F.count_distinct(*args)
        if function.distinct is None:
            raise TypeProblem(f"{agg.name}() doesn't take DISTINCT")
        # the planner has made the argument a column of its own
        return F.expr(function.distinct.format(*[f"`{a.uid}`" for a in agg.args])).cast(agg.type)
