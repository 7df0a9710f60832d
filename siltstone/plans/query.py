"""Running a query: which optimisations show is a choice of features, the rest is Catalyst's work."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.aggregates import columns_for
from siltstone.functions.predicates import condition
from siltstone.operators import bloom, zonemap
from siltstone.plans.ast import MODES, And, Comparison, Feature, Filter, Query
from siltstone.plans.parser import parse_query

ROWS_PER_GROUP = 550


@dataclass(frozen=True)
class Result:
    """``aggregates``: one row, or one a file; None unless asked for."""

    rows: DataFrame
    aggregates: DataFrame | None = None


def features_of(mode: str | Iterable[Feature]) -> frozenset[Feature]:
    return MODES[mode] if isinstance(mode, str) else frozenset(mode)


def _equalities(f: Filter | None) -> list[Comparison]:
    """Equalities that every row of the result meets."""
    match f:
        case Comparison(op="=="):
            return [f]
        case And(left=a, right=b):
            return _equalities(a) + _equalities(b)
    return []


def run(source: DataFrame, query: Query, mode: str | Iterable[Feature] = "aggr", *, rows_per_group: int = ROWS_PER_GROUP, coerce: bool = False, strict_null: bool = False, extended: bool = False, per_file: bool = False) -> Result:
    """``source`` is a scan (``group``, ``bloom`` without ``row``, and ``per_file`` need a file source; the first two read
    the files' row groups themselves). ``rows_per_group`` sizes an explicit bloom filter.

    Without ROW rows are not filtered: GROUP and BLOOM alone give all rows of the blocks that stay. With it they add
    nothing to the result, and the Parquet reader skips the same blocks itself. Without COLUMN the select list is
    ignored. Columns come in the table's order; unknown selected or aggregated ones are left out.
    """
    on = features_of(mode)
    df = source
    if query.filter is not None:
        passes = condition(query.filter, df.schema, coerce, strict_null)
        if Feature.ROW in on:
            df = df.where(passes)
        elif Feature.BLOOM in on:
            df = zonemap.prune_groups(df, query.filter if Feature.GROUP in on else None, "_group_of_row")
            for f in _equalities(query.filter):
                df = bloom.prune_equal(df, f, F.col("_group_of_row"), rows_per_group)
            df = df.drop("_group_of_row")
        elif Feature.GROUP in on:
            df = zonemap.prune_groups(df, query.filter)
    rows = df
    if Feature.COLUMN in on and query.select is not None:
        rows = df.select(*[f"`{c}`" for c in source.columns if c in query.select])
    if Feature.AGGR not in on:
        return Result(rows)
    made = columns_for(query.aggregates, source.schema, extended)
    if not made:
        return Result(rows, source.sparkSession.range(0).select())
    if per_file:
        return Result(rows, df.groupBy(F.col("_metadata.file_path").alias("file")).agg(*made))
    return Result(rows, df.agg(*made))


def query_parquet(spark: SparkSession, path: str, filter: str = "", select: str = "", aggregates: str = "", mode: str | Iterable[Feature] = "aggr", **options: bool) -> Result:
    """The three strings of a query over a Parquet file or folder."""
    return run(spark.read.parquet(path), parse_query(filter, select, aggregates), mode, **options)
