"""A six-row example file with two rows in a row group."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources import layout

#: Name, Age, Birthday in milliseconds since 1970, Graduated, Float (the last two: a float's extremes).
ROWS = (
    ("Alice", 10, 1420074061000, False, 11.11),
    ("Bob", 60, 1104541261000, False, -22.22),
    ("Charlie", 30, 788922061000, True, 0.0),
    ("Dave", -30, 473389261000, False, 44.44),
    ("Eve", 50, 157770061, True, -3.4028234663852886e38),
    ("Frank", 0, 1735693261000, True, 3.4028234663852886e38),
)


def table(spark: SparkSession) -> DataFrame:
    rows = [(n, a, datetime(1970, 1, 1) + timedelta(milliseconds=b), g, f) for n, a, b, g, f in ROWS]
    df = spark.createDataFrame(rows, "Name string, Age int, Birthday timestamp_ntz, Graduated boolean, Float double")
    return df.withColumn("Age", F.col("Age").cast("tinyint")).withColumn("Float", F.col("Float").cast("float"))


def write(spark: SparkSession, path: str) -> None:
    layout.write_groups(table(spark).coalesce(1), path, rows=2, compression="snappy")
