"""Bloom filters: written into Parquet for the reader to use, and as an explicit operator over zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.predicates import field_of, value_for
from siltstone.plans.ast import Comparison

HASHES, SLOTS_PER_ROW = 3, 6


def writer_options(columns: dict[str, int]) -> dict[str, str]:
    """Options of a Parquet writer for a filter on each column, sized for its distinct values in a row group (without
    a number the writer takes a megabyte for each)."""
    out = {}
    for name, distinct in columns.items():
        out[f"parquet.bloom.filter.enabled#{name}"] = "true"
        out[f"parquet.bloom.filter.expected.ndv#{name}"] = str(distinct)
    return out


def slots(value: Column, size: Column | int) -> Column:
    """The slots that a value sets in a filter of ``size`` slots."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.array(*[F.pmod(F.xxhash64(value, F.lit(k)), size) for k in range(HASHES)])


def prune_equal(df: DataFrame, f: Comparison, zone: Column, rows_per_zone: int) -> DataFrame:
    """All rows of the zones whose filter may hold the value of ``f`` (an equality); false positives stay.

    Each zone sets the slots of its values; a zone stays if all slots of the sought value are set. Only those slots
    are followed, so a zone costs HASHES flags.
    """
    if f.op != "==":
        return df
    t = field_of(df.schema, f.column).dataType
    c = F.col(f"`{f.column}`")
    size = rows_per_zone * SLOTS_PER_ROW
    sought = slots(value_for(f.literal, t).cast(t), size)
    has = [F.max(F.array_contains(slots(c, size), F.get(sought, F.lit(k)))) for k in range(HASHES)]
    flags = df.where(c.isNotNull()).groupBy(zone.alias("_zone")).agg(*[h.alias(f"h{k}") for k, h in enumerate(has)])
    stay = flags.where(" and ".join(f"h{k}" for k in range(HASHES))).select("_zone")
    return df.withColumn("_zone", zone).join(stay, "_zone", "left_semi").drop("_zone")
