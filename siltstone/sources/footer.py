"""Parquet footers as tables, read on the executors, and reading chosen row groups."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.sources import scan, scratch
from siltstone.sources.scan import list_files

SCHEMA = "path string, file_bytes long, footer_bytes long, row_group int, rows long, group_bytes long, group_meta_bytes long, columns int"
MAGIC, LEAST_BYTES = b"PAR1", 12
#: Files that a task looks through.
FILES_PER_TASK = 16


def _spread(spark: SparkSession, paths: list[str]) -> DataFrame:
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    return df.repartition(max(1, min(len(paths), max(4 * spark.sparkContext.defaultParallelism, len(paths) // FILES_PER_TASK))))


def _open(path: str):
    import pyarrow.fs as fs

    store, at = fs.FileSystem.from_uri("s3" + path[3:] if path.startswith(("s3a:", "s3n:")) else path)
    return store.open_input_file(at)


def _footer_length(f, path: str) -> tuple[int, int]:
    """(size of the file, of its footer); what isn't Parquet is an error."""
    size = f.size()
    if size < LEAST_BYTES:
        raise ValueError(f"{path}: too short for Parquet")
    f.seek(size - 8)
    length, magic = struct.unpack("<I4s", f.read(8))
    if magic != MAGIC:
        raise ValueError(f"{path}: not Parquet")
    return size, length


def footers(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each row group; ``group_meta_bytes``: of its metadata alone, as JSON. A file that is too short, or
    without the format's mark, is an error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        for b in batches:
            for path in b.column(0).to_pylist():
                with _open(path) as f:
                    size, length = _footer_length(f, path)
                    meta = pq.read_metadata(f)
                groups = [meta.row_group(i) for i in range(meta.num_row_groups)]
                rows = [(path, size, length, i, g.num_rows, g.total_byte_size, len(json.dumps(g.to_dict(), default=str)), g.num_columns) for i, g in enumerate(groups)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 8, kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return _spread(spark, list_files(spark, folder)).mapInArrow(read, SCHEMA)


def sound(spark: SparkSession, paths: list[str]) -> tuple[list[str], dict[str, str]]:
    """(files that have rows, why each of the others has none), in one job. Only what the bytes of a file prove makes it
    a broken one; any other failure, of storage or cluster, is raised."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for b in batches:
            said = []
            for path in b.column(0).to_pylist():
                with _open(path) as f:
                    try:
                        _footer_length(f, path)
                        said.append("" if pq.read_metadata(f).num_rows else "no rows")
                    except (ValueError, pa.ArrowInvalid) as e:  # pyarrow's is a ValueError, too
                        said.append(str(e) or "broken")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(said, pa.string())], names=["path", "why"])

    why = dict(_spread(spark, paths).mapInArrow(read, "path string, why string").collect()) if paths else {}
    return [p for p in paths if not why[p]], {p: why[p] for p in paths if why[p]}


def group_statistics(spark: SparkSession, paths: list[str], schema: T.StructType, columns: list[str]) -> DataFrame:
    """path, row_group, rows and, for each of ``columns`` (flat ones) in order, min_i and max_i (for floats also nan_i),
    from the footers alone; null where a file lacks the column or its writer left no statistics. Footers don't tell
    whether a float column holds NaN, so nan_i is null."""
    from pyspark.sql.pandas.types import to_arrow_type

    types = [schema[c].dataType for c in columns]
    kinds = [to_arrow_type(t) for t in types]
    floats = [isinstance(t, (T.FloatType, T.DoubleType)) for t in types]
    names, ddl = ["path", "row_group", "rows"], ["path string", "row_group int", "rows long"]
    for i, t in enumerate(types):
        names += [f"min_{i}", f"max_{i}"] + [f"nan_{i}"] * floats[i]
        ddl += [f"min_{i} {t.simpleString()}", f"max_{i} {t.simpleString()}"] + [f"nan_{i} boolean"] * floats[i]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for b in batches:
            for path in b.column(0).to_pylist():
                with _open(path) as f:
                    meta = pq.read_metadata(f)
                groups = [meta.row_group(i) for i in range(meta.num_row_groups)]
                at = {meta.schema.column(k).path: k for k in range(meta.num_columns)}
                out = [pa.array([path] * len(groups), pa.string()), pa.array(range(len(groups)), pa.int32()), pa.array([g.num_rows for g in groups], pa.int64())]
                for name, kind, is_float in zip(columns, kinds, floats, strict=True):
                    stats = [g.column(at[name]).statistics if name in at else None for g in groups]
                    out += [pa.array([getattr(s, side) if s is not None and s.has_min_max else None for s in stats]).cast(kind) for side in ("min", "max")]
                    out += [pa.nulls(len(groups), pa.bool_())] * is_float
                yield pa.RecordBatch.from_arrays(out, names=names)

    return _spread(spark, paths).mapInArrow(read, ", ".join(ddl))


def statistics(spark: SparkSession, folder: str, column: str) -> DataFrame:
    """path, row_group, rows, min_0 and max_0 of one flat column; see ``group_statistics``."""
    schema = spark.read.parquet(folder).schema
    return group_statistics(spark, list_files(spark, folder), schema, [column]).select("path", "row_group", "rows", "min_0", "max_0")


def read_groups(groups: DataFrame, schema: T.StructType, tag: str | None = None) -> DataFrame:
    """The rows of ``groups`` (path, row_group), columns as in ``schema``: of each file only the bytes of these groups
    and columns are read. What they were is added to ``scan``'s counters. ``tag``: a column that tells a row's group."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark, target = groups.sparkSession, to_arrow_schema(schema)
    rows_read, bytes_read = scan.counters(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for b in batches:
            wanted: dict[str, list[int]] = {}
            for path, group in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                wanted.setdefault(path, []).append(group)
            for path, found in wanted.items():
                with _open(path) as f:
                    file = pq.ParquetFile(f)
                    have = [n for n in target.names if n in file.schema_arrow.names]
                    for g in sorted(found):
                        meta = file.metadata.row_group(g)
                        rows_read.add(meta.num_rows)
                        bytes_read.add(sum(meta.column(k).total_compressed_size for k in range(meta.num_columns) if meta.column(k).path_in_schema.split(".")[0] in have))
                        t = file.read_row_group(g, columns=have)
                        cols = [t.column(n).cast(target.field(n).type) if n in have else pa.chunked_array([pa.nulls(t.num_rows, target.field(n).type)]) for n in target.names]
                        t = pa.table(cols, schema=target)
                        yield from (t if tag is None else t.append_column(tag, pa.array([f"{path}#{g}"] * t.num_rows, pa.string()))).to_batches()

    tasks = 4 * spark.sparkContext.defaultParallelism
    return groups.select("path", "row_group").repartition(tasks, "path", "row_group").sortWithinPartitions("path", "row_group").mapInArrow(read, T.StructType([*schema.fields, *([T.StructField(tag, T.StringType())] if tag else [])]))


def metadata_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """Per file: row_groups, rows_per_group and ratio of footer to file bytes."""
    f = footers(spark, folder)
    return f.groupBy("path").agg(F.count("*").alias("row_groups"), F.avg("rows").alias("rows_per_group"), (F.max("footer_bytes") / F.max("file_bytes")).alias("ratio"))


def thresholds(maxima: DataFrame, column: str = "max_0") -> DataFrame:
    """(pct, threshold) for 0 to 99: the value that the maxima of that share of blocks exceed, from one row a block.

    Blocks in order of their maxima; a share takes the one n - floor(n/100 * pct) from below, the last at most. There
    may be a row for every few hundred rows of the data, so they are sorted by ranges, and a range's rows are numbered
    from the number of rows in the ranges before it.
    """
    spark = maxima.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = scratch.path(spark, "ranges")
    maxima.select(F.col(column).alias("threshold")).repartitionByRange(ranges, "threshold").withColumn("part", F.spark_partition_id()).write.parquet(path)
    ranked = spark.read.parquet(path)
    counts = ranked.groupBy("part").count()  # a row a range
    before = counts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    n = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    ranked = ranked.join(F.broadcast(before), "part").withColumn("i", F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("threshold")) - 1)
    at = F.least(F.lit(n - 1), n - F.floor(F.lit(n) / 100 * F.col("id")))
    return ranked.join(F.broadcast(spark.range(100).select(F.col("id").alias("pct"), at.alias("i"))), "i").select("pct", "threshold")
