"""File layout: row groups of a given number of rows, and compaction of many files into few."""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from siltstone.sources import footer
from siltstone.sources.scan import list_files

ROWS_PER_GROUP, FILES = 550, 16


@dataclass(frozen=True)
class Compacted:
    """Paths of the outputs, and of the inputs left out with the reason."""

    outputs: list[str]
    left_out: dict[str, str]


def write_groups(df: DataFrame, path: str, rows: int = ROWS_PER_GROUP, compression: str = "snappy", **options: str) -> None:
    """Write with at most ``rows`` rows in a row group; an existing path is an error."""
    df.write.options(**{"parquet.block.row.count.limit": str(rows)}, **options).option("compression", compression).parquet(path)


def rewrite(spark: SparkSession, source: str, target: str, rows: int = ROWS_PER_GROUP, compression: str = "uncompressed") -> None:
    """A file or folder again with other row groups. The source stays as it is."""
    write_groups(spark.read.parquet(source), target, rows, compression)


def compact(spark: SparkSession, folder: str, target: str, files: int = FILES, rows: int = ROWS_PER_GROUP) -> Compacted:
    """At most ``files`` outputs, of successive equal shares of the sorted inputs; plain encoding, uncompressed.

    Inputs whose bytes show that they are broken, and empty ones, are left out and named; any other failure is raised.
    The schema is that of the first good one. One job looks at all footers, one writes all outputs, a task each.
    """
    inputs = list_files(spark, folder)
    good, left_out = footer.sound(spark, inputs)
    if not good:
        return Compacted([], left_out)
    share, kept = math.ceil(len(inputs) / files), set(good)
    schema = spark.read.parquet(good[0]).schema
    parts = [p for k in range(0, len(inputs), share) if (p := [x for x in inputs[k : k + share] if x in kept])]
    outputs = functools.reduce(DataFrame.unionAll, [spark.read.schema(schema).parquet(*p).coalesce(1) for p in parts])
    # the shares stay partitions of their own, instead of one that joins partitions of like places
    name = "spark.sql.unionOutputPartitioning"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        write_groups(outputs, target, rows, "uncompressed", **{"parquet.enable.dictionary": "false"})
    finally:
        spark.conf.set(name, was) if was is not None else spark.conf.unset(name)
    return Compacted(list_files(spark, target), left_out)
