"""Global aggregates: one row, a column for each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.predicates import FLOATS, INTEGERS, is_whole
from siltstone.plans.ast import Aggregate


def column_for(a: Aggregate, t: T.DataType, extended: bool = False) -> Column | None:
    """None where the type has no aggregate. ``extended`` adds COUNT of every type and MIN/MAX of ordered ones.

    SUM of nothing is 0, the others are null (COUNT 0). Integers widen to bigint, floats to double. MIN and MAX pass
    over NaN, SUM and AVG don't.
    """
    c = F.col(f"`{a.column}`")
    wide = "bigint" if isinstance(t, INTEGERS) else "double" if isinstance(t, FLOATS) else None
    if wide is None and not is_whole(t):
        if extended and a.op == "COUNT":
            return F.count(c).alias(a.name)
        if extended and a.op in ("MIN", "MAX") and isinstance(t, T.AtomicType):
            return (F.min(c) if a.op == "MIN" else F.max(c)).alias(a.name)
        return None
    real = F.when(~F.isnan(c), c) if isinstance(t, FLOATS) else c
    out = {
        "SUM": lambda: F.coalesce(F.sum(c), F.lit(0)),
        "AVG": lambda: F.avg(c).cast("double"),
        "COUNT": lambda: F.count(c),
        "MIN": lambda: F.min(real),
        "MAX": lambda: F.max(real),
    }[a.op]()
    if wide and a.op in ("SUM", "MIN", "MAX"):
        out = out.cast(wide)
    return out.alias(a.name)


def columns_for(aggregates: tuple[Aggregate, ...], schema: T.StructType, extended: bool = False) -> list[Column]:
    """Those of known columns with a type that has them, in order."""
    types = {f.name: f.dataType for f in schema.fields}
    made = (column_for(a, types[a.column], extended) for a in aggregates if a.column in types)
    return [c for c in made if c is not None]
