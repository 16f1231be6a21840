"""SQL type names, Spark types, and which values fit which."""

from __future__ import annotations

from pyspark.sql import types as T

from quillon.errors import TypeProblem

NUMERIC = T.DecimalType(38, 18)
BY_NAME = {
    "text": T.StringType(),
    "smallint": T.ShortType(),
    "integer": T.IntegerType(),
    "bigint": T.LongType(),
    "real": T.FloatType(),
    "double precision": T.DoubleType(),
    "numeric": NUMERIC,
    "boolean": T.BooleanType(),
    "timestamp with time zone": T.TimestampType(),
}
TEXT, BOOLEAN, INTEGER, BIGINT, DOUBLE = (BY_NAME[n] for n in ("text", "boolean", "integer", "bigint", "double precision"))
NULL = T.NullType()
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: The numeric tower, lowest first.
TOWER = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
MOMENTS = (T.TimestampType, T.TimestampNTZType, T.DateType)


def spark_type(name: str) -> T.DataType:
    return BY_NAME[name]


def name_of(kind: T.DataType) -> str:
    for name, known in BY_NAME.items():
        if type(known) is type(kind):
            return name
    return kind.simpleString()


def is_number(kind) -> bool:
    return isinstance(kind, TOWER)


def is_whole(kind) -> bool:
    return isinstance(kind, WHOLE)


def is_null(kind) -> bool:
    return isinstance(kind, T.NullType)


def promoted(a, b):
    """The numeric type that holds both, or a problem."""
    if is_null(a):
        a = b
    if is_null(b):
        b = a
    if not (is_number(a) and is_number(b)):
        raise TypeProblem(f"numbers are needed, not {name_of(a)} and {name_of(b)}")
    higher = max((a, b), key=lambda k: TOWER.index(type(k)))
    return NUMERIC if isinstance(higher, T.DecimalType) else higher


def common(a, b, what: str = "compare"):
    """The type in which values of both can be compared or put into one column."""
    if is_null(a) or type(a) is type(b):
        return NUMERIC if isinstance(b, T.DecimalType) else b
    if is_null(b):
        return a
    if is_number(a) and is_number(b):
        return promoted(a, b)
    if isinstance(a, MOMENTS) and isinstance(b, MOMENTS):
        return max((a, b), key=lambda k: isinstance(k, T.TimestampType))
    raise TypeProblem(f"cannot {what} {name_of(a)} and {name_of(b)}")


def assignable(to, value) -> bool:
    """Whether a value may be stored: equal types, any number in any number, null anywhere,
    text in a timestamp (it is parsed)."""
    return (
        is_null(value)
        or type(to) is type(value)
        or (is_number(to) and is_number(value))
        or (isinstance(to, MOMENTS) and isinstance(value, (T.StringType, *MOMENTS)))
    )
