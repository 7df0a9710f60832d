"""Zone maps: least and greatest value of columns for blocks of rows, and which blocks a filter can leave out.

Spark's Parquet reader skips row groups by itself when rows are filtered. This is the explicit form, an operator whose
result is all rows of the blocks that stay: for the files' real row groups, told by their footers, and for any zones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.predicates import FLOATS, QueryError, field_of, is_whole, value_for
from siltstone.plans.ast import And, Comparison, Filter, Not, Or, columns_of
from siltstone.sources import footer

_EPSILON = 2.0**-52


def ordered(t: T.DataType) -> bool:
    return is_whole(t) or isinstance(t, (*FLOATS, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))


def physical_zone(rows: int) -> list[Column]:
    """Blocks of ``rows`` rows of each file, as a writer with that limit lays them out."""
    return [F.col("_metadata.file_path").alias("_zone_file"), F.floor(F.col("_metadata.row_index") / rows).alias("_zone_group")]


def zone_map(df: DataFrame, zone: Column | list[Column], columns: list[str]) -> DataFrame:
    """zone columns, then min_i, max_i for each of ``columns`` in order, and n (rows). NaN counts as no value there;
    for floats nan_i tells whether there is one."""
    made = []
    for i, name in enumerate(columns):
        c = F.col(f"`{name}`")
        if isinstance(df.schema[name].dataType, FLOATS):
            made.append(F.coalesce(F.max(F.isnan(c)), F.lit(False)).alias(f"nan_{i}"))
            c = F.when(~F.isnan(c), c)
        made += [F.min(c).alias(f"min_{i}"), F.max(c).alias(f"max_{i}")]
    return df.groupBy(*(zone if isinstance(zone, list) else [zone])).agg(*made, F.count(F.lit(1)).alias("n"))


def keep(f: Filter, columns: list[str], schema: T.StructType, negated: bool = False) -> Column:
    """Whether a zone can hold a row that the filter (or its negation) lets through; what can't be told is kept.

    A row holding null passes neither, so zones are judged by their values alone; a zone without values is kept.
    """
    match f:
        case Not(of=inner):
            return keep(inner, columns, schema, not negated)
        case And(left=a, right=b) | Or(left=a, right=b):
            x, y = keep(a, columns, schema, negated), keep(b, columns, schema, negated)
            return x & y if isinstance(f, And) != negated else x | y
        case Comparison(column=name, op=op, literal=lit):
            try:
                t = field_of(schema, name).dataType
                v = value_for(lit, t)
            except QueryError:
                return F.lit(True)
            if name not in columns:
                return F.lit(True)
            low, high = F.col(f"min_{columns.index(name)}"), F.col(f"max_{columns.index(name)}")
            if isinstance(t, T.BooleanType):
                one = (low == v) & (high == v) if negated else (low == v) | (high == v)
                return F.coalesce((~one if negated else one) if op == "==" else F.lit(True), F.lit(True))
            alone = (low == v) & (high == v)
            if isinstance(t, FLOATS):
                alone = (F.abs(low - v) < _EPSILON) & (F.abs(high - v) < _EPSILON)
            test = {
                ("<", False): low < v, ("<", True): high >= v,
                ("<=", False): low <= v, ("<=", True): high > v,
                ("==", False): (low <= v) & (v <= high), ("==", True): ~alone,
                (">=", False): high >= v, (">=", True): low < v,
                (">", False): high > v, (">", True): low <= v,
            }[op, negated]
            if negated and isinstance(t, FLOATS):  # NaN passes the negation of any comparison
                test = test | F.col(f"nan_{columns.index(name)}")
            return F.coalesce(test, F.lit(True))
    raise QueryError(f"not a filter: {f!r}")


def filter_columns(df: DataFrame, f: Filter) -> list[str]:
    return [c for c in columns_of(f) if c in df.columns and ordered(df.schema[c].dataType)]


def prune_groups(df: DataFrame, f: Filter | None, tag: str | None = None) -> DataFrame:
    """All rows of the row groups of ``df`` (a scan of Parquet files) that the filter can't leave out.

    Judged by the files' own footers; of the others not a byte is read. ``tag``: see ``read_groups``.
    """
    columns = filter_columns(df, f) if f is not None else []
    groups = footer.group_statistics(df.sparkSession, sorted(df.inputFiles()), df.schema, columns)
    return footer.read_groups(groups.where(keep(f, columns, df.schema)) if columns else groups, df.schema, tag)


def prune(df: DataFrame, f: Filter, zone: Column | list[Column]) -> DataFrame:
    """All rows of the zones that the filter can't leave out: a superset of the rows that pass it."""
    zones = zone if isinstance(zone, list) else [zone]
    columns = filter_columns(df, f)
    if not columns:
        return df
    named = [z.alias(f"_zone_{i}") for i, z in enumerate(zones)]
    keys = [f"_zone_{i}" for i in range(len(zones))]
    # adaptive execution knows its size before it chooses the join
    stay = zone_map(df, named, columns).where(keep(f, columns, df.schema)).select(*keys)
    tagged = df.select("*", *named)
    same = [tagged[k].eqNullSafe(stay[k]) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return tagged.join(stay, on, "left_semi").drop(*keys)
