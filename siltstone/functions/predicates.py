"""From a filter tree to a Spark column, with the language's types checked on the driver."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.plans.ast import And, Comparison, Filter, Kind, Literal, Not, Or

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)
TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)
_EPOCH = datetime(1970, 1, 1)


class QueryError(ValueError):
    """A filter that doesn't fit the table; raised before any job."""


def field_of(schema: T.StructType, name: str) -> T.StructField:
    for f in schema.fields:
        if f.name == name:
            return f
    raise QueryError(f"Column '{name}' not found")


def is_whole(t: T.DataType) -> bool:
    """Integers, also unsigned ones of 64 bits, which are read as decimal(20,0)."""
    return isinstance(t, INTEGERS) or isinstance(t, T.DecimalType) and t.scale == 0 and t.precision == 20


def epoch_millis(x: datetime) -> int:
    return round((x - _EPOCH) / timedelta(milliseconds=1))


def value_for(lit: Literal, t: T.DataType, coerce: bool = False) -> Column:
    """The literal as the column's type compares with it, or an error.

    A date and time is a number of milliseconds to integer columns, and a number is one to columns of time.
    """
    kind, v = lit.kind, lit.value
    if is_whole(t) and kind in (Kind.INTEGER, Kind.DATETIME):
        return F.lit(epoch_millis(v) if kind is Kind.DATETIME else v).cast("bigint")
    if isinstance(t, FLOATS) and (kind is Kind.FLOAT or coerce and kind is Kind.INTEGER):
        return F.lit(float(v))
    if coerce and is_whole(t) and kind is Kind.FLOAT:
        return F.lit(v)
    if isinstance(t, T.BooleanType) and kind is Kind.BOOLEAN or isinstance(t, T.StringType) and kind is Kind.STRING:
        return F.lit(v)
    if isinstance(t, TIMES) and kind in (Kind.DATETIME, Kind.INTEGER):
        at = v if kind is Kind.DATETIME else _EPOCH + timedelta(milliseconds=v)
        return F.lit(at.replace(tzinfo=UTC)) if isinstance(t, T.TimestampType) else F.lit(at).cast("timestamp_ntz")
    raise QueryError(f"Unsupported comparison of {t.simpleString()} with {kind.value} {v!r}")


def compare(c: Column, op: str, v: Column, t: T.DataType) -> Column:
    match op:
        case "<":
            return c < v
        case "<=":
            return c <= v
        case "==":
            return c == v
        # to Spark NaN is the greatest number; here it compares with nothing
        case ">":
            return (c > v) & ~F.isnan(c) if isinstance(t, FLOATS) else c > v
        case ">=":
            return (c >= v) & ~F.isnan(c) if isinstance(t, FLOATS) else c >= v
    raise QueryError(f"unknown operator {op!r}")


def condition(f: Filter, schema: T.StructType, coerce: bool = False, strict_null: bool = False) -> Column:
    """``strict_null``: AND and OR are null if either side is, whatever the other says; else SQL's rules hold."""
    match f:
        case Comparison(column=name, op=op, literal=lit):
            t = field_of(schema, name).dataType
            return compare(F.col(f"`{name}`"), op, value_for(lit, t, coerce), t)
        case Not(of=inner):
            return ~condition(inner, schema, coerce, strict_null)
        case And(left=a, right=b) | Or(left=a, right=b):
            x, y = condition(a, schema, coerce, strict_null), condition(b, schema, coerce, strict_null)
            joined = x & y if isinstance(f, And) else x | y
            return F.when(x.isNull() | y.isNull(), F.lit(None).cast("boolean")).otherwise(joined) if strict_null else joined
    raise QueryError(f"not a filter: {f!r}")
