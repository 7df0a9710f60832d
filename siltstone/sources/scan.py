"""Reading: whole-table scans, raw bytes, and what a run has read."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(spark: SparkSession, path: str, limit_files: int | None = None) -> DataFrame:
    """The ``*.parquet`` files of a folder (or one file), at most so many of them in order of their names."""
    if limit_files is None:
        return spark.read.option("pathGlobFilter", "*.parquet").parquet(path)
    files = list_files(spark, path)[:limit_files]
    return spark.read.parquet(*files)


def list_files(spark: SparkSession, path: str, suffix: str = ".parquet") -> list[str]:
    """Sorted paths of a folder's files (or the one file), by Hadoop's file systems, so that any store works."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p) and fs.getFileStatus(p).isFile():
        return [str(fs.getFileStatus(p).getPath())]
    return sorted(str(s.getPath()) for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(path, f"*{suffix}")) or () if s.isFile())


def raw_bytes(spark: SparkSession, path: str) -> DataFrame:
    """One row: files and bytes, every byte read without decoding."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).agg(F.count("*").alias("files"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).cast("long").alias("bytes"))


_counters: dict[str, tuple] = {}


def counters(spark: SparkSession) -> tuple:
    """Accumulators of rows and bytes that this package's own reader, not Spark's, took from storage."""
    sc = spark.sparkContext
    if sc.applicationId not in _counters:
        _counters[sc.applicationId] = (sc.accumulator(0), sc.accumulator(0))
    return _counters[sc.applicationId]


def console(df: DataFrame, rows: int = 20) -> str:
    """Print the first rows as a table; the text is returned as well."""
    text = df._show_string(rows, False)
    print(text)
    return text


def discard(df: DataFrame) -> None:
    """Run a plan to its end and drop the rows."""
    df.write.format("noop").mode("overwrite").save()


@dataclass(frozen=True)
class Measured:
    seconds: float
    rows_read: int
    bytes_read: int


def measured(df: DataFrame) -> Measured:
    """Run ``df`` into nothing; rows and bytes that its scans took from storage.

    Bytes count in full only with ``spark.hadoop.parquet.hadoop.vectored.io.enabled=false``.
    """
    sc = df.sparkSession.sparkContext
    own = counters(df.sparkSession)
    before = [x.value for x in own]
    group = uuid.uuid4().hex
    sc.setJobGroup(group, "measured scan")
    began = time.perf_counter()
    try:
        discard(df)
    finally:
        seconds = time.perf_counter() - began
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    tracker, store, (rows, size) = sc.statusTracker(), sc._jsc.sc().statusStore(), (x.value - y for x, y in zip(own, before, strict=True))
    for job in tracker.getJobIdsForGroup(group):
        info = tracker.getJobInfo(job)
        for stage in info.stageIds if info else ():
            try:
                s = store.lastStageAttempt(stage)
            except Exception:  # a stage that was skipped has no attempt
                continue
            rows, size = rows + s.inputRecords(), size + s.inputBytes()
    return Measured(seconds, rows, size)
