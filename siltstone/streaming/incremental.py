"""The same queries over a stream of files: filter and projection are row by row, aggregates are kept complete."""

from __future__ import annotations

from pyspark.sql import DataFrame

from siltstone.functions.aggregates import columns_for
from siltstone.functions.predicates import condition
from siltstone.plans.ast import Query


def rows(stream: DataFrame, query: Query) -> DataFrame:
    df = stream if query.filter is None else stream.where(condition(query.filter, stream.schema))
    return df if query.select is None else df.select(*[f"`{c}`" for c in stream.columns if c in query.select])


def aggregates(stream: DataFrame, query: Query) -> DataFrame:
    """For output mode ``complete``: the state is one row, however long the stream."""
    df = stream if query.filter is None else stream.where(condition(query.filter, stream.schema))
    return df.agg(*columns_for(query.aggregates, stream.schema))
