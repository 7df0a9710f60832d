"""Shared pieces of the training-data operators: scratch tables, word splitting and hashing, small graph work.

Words are always maximal runs of bytes outside ``\\x20 \\x09-\\x0D``; ``bytes.split()`` splits UTF-8 at exactly
these six characters, so Python and JVM code agree.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import tempfile
import time
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"
BATCH_BYTES = "2m"
_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """This application's folder under the shared one that ``spark.checkpoint.dir`` names; it goes when the session
    ends. Where the setting is missing a private folder serves local mode; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.applicationId not in _roots:
        root = sc.getConf().get("spark.checkpoint.dir", None)
        if not root:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            root = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        root = f"{root.rstrip('/')}/siltstone/{sc.applicationId}"
        path = sc._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _roots[sc.applicationId] = root
    return _roots[sc.applicationId]


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for the time of a job."""
    was = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, was) if was is not None else spark.conf.unset(name)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back: cuts lineage, survives lost executors.

    Small tables get few files: partitions are merged up to the advisory size rather than spread over all cores. Python
    workers get BATCH_BYTES at a time; both they and the JVM hold several batches. What was shuffled for the table goes
    from the disks as soon as it is written.
    """
    path = scratch_path(df.sparkSession, tag)
    _write(df, path)
    return _read(df, path)


def materialize_parts(df: DataFrame, column: str, values: Iterable[int], tag: str) -> dict[int, DataFrame]:
    """Like ``materialize``, but a table for each value of a column (without it), so that each can be released."""
    path = scratch_path(df.sparkSession, tag)
    _write(df, path, column)
    sc, out = df.sparkSession.sparkContext, {}
    for v in values:
        folder = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/{column}={v}")
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).mkdirs(folder)  # none is there if no row has the value
        out[v] = _read(df.drop(column), f"{path}/{column}={v}")
    return out


def _write(df: DataFrame, path: str, *by: str) -> None:
    spark = df.sparkSession
    with setting(spark, "spark.sql.adaptive.coalescePartitions.parallelismFirst", "false"), setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)


def _read(df: DataFrame, path: str) -> DataFrame:
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


#: The tables that ``materialize`` wrote and that are still referred to.
_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, when nothing will read them again; others stay as they are."""
    for df in tables:
        if (name := _written.pop(df, None)) is not None:
            sc = df.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def row_key() -> Column:
    """A number for each row of a written table that reruns of a task agree on; to spread rows that are all alike."""
    return F.xxhash64("_metadata.file_path", "_metadata.row_index")


def uniform(*cols: Column | str, seed: int = 0) -> Column:
    """A repeatable number in (0, 1) from the given columns."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11)
    return (bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-53)


def about(df: DataFrame, key: str, most: int, seed: int = 0) -> DataFrame:
    """All rows, or a repeatable random share of them of ``most`` rows on average, by the hash of ``key``: no task
    gathers or sorts anything."""
    n = df.count()
    return df if n <= most else df.where(uniform(key, seed=seed) < most / n)


def most_used(df: DataFrame, weight: str, limit: int) -> Column:
    """A condition that up to ``limit`` rows meet, those of the greatest weights (a positive number): the cut is found
    by a histogram, so that no task gathers the rows of all others."""
    step = F.floor(F.log2(F.col(weight).cast("double")) * 64).cast("int")
    found, cut = 0, None
    for r in sorted(df.groupBy(step.alias("step")).count().collect(), reverse=True):  # 64 rows for each power of two
        found += r["count"]
        if found > limit:
            break
        cut = r["step"]
    return F.lit(False) if cut is None else step >= cut


def ascii_lower(c: Column) -> Column:
    """A-Z only. ``lower`` does the same on pure ASCII and is far cheaper than ``translate``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


#: Bytes of text that are worked on at once; a longer text stands alone.
GROUP_BYTES = 1 << 19


def text_groups(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """(start, end, texts) of successive slices of GROUP_BYTES or so: only they become Python objects and work arrays."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start = size = 0
    for i, n in enumerate(sizes.tolist()):
        if size and size + n > GROUP_BYTES:
            yield start, i, texts(column.slice(start, i - start))
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes), texts(column.slice(start))
    give_back()


# ---------------------------------------------------------------- vectorised word hashing

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Longer spans are hashed one by one.
LONG = 64
_MIX = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9FB21C651E98DF25))
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix64(x: np.ndarray, which: int = 0) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    m, half = _MIX[which], np.uint64(32)
    x = (x ^ (x >> half)) * m
    x = (x ^ (x >> half)) * m
    return x ^ (x >> half)


_FIRST = tuple(mix64(np.arange(LONG + 1, dtype=np.uint64) + _ODD[k], k) for k in (0, 1))


def eights(raw: np.ndarray) -> np.ndarray:
    """At each byte it and the next seven, as a number; the end counts as followed by zeros."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of each span of bytes; ``which`` (0, 1) chooses one of two independent ones.

    Eight bytes after the other are mixed in, each time by a bijection: spans of up to eight bytes and of one length
    never share a hash, longer ones only by chance.
    """
    at, n = eights(raw), ends - starts
    h = mix64(_FIRST[which][np.minimum(n, LONG)] ^ (at[starts] & _MASK[np.minimum(n, 8)]), which)
    todo = np.flatnonzero(n > 8)
    for k in range(8, LONG, 8):
        todo = todo[n[todo] > k]
        if not len(todo):
            break
        h[todo] = mix64(h[todo] ^ (at[starts[todo] + k] & _MASK[np.minimum(n[todo] - k, 8)]), which)
    todo = todo[n[todo] > LONG]
    if len(todo):
        own = [hashlib.blake2b(raw[a:b], digest_size=8, salt=bytes([which])).digest() for a, b in zip(starts[todo].tolist(), ends[todo].tolist(), strict=True)]
        h[todo] = np.frombuffer(b"".join(own), np.uint64)
    return h


def same_spans(raw: np.ndarray, a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Whether span i of one list has the bytes of span i of the other."""
    n = a_ends - a
    out, at = n == b_ends - b, eights(raw)
    todo = np.flatnonzero(out)
    for k in range(0, LONG, 8):
        todo = todo[n[todo] > k]
        if not len(todo):
            return out
        same = (at[a[todo] + k] ^ at[b[todo] + k]) & _MASK[np.minimum(n[todo] - k, 8)] == 0
        out[todo[~same]] = False
        todo = todo[same]
    for i in todo[n[todo] > LONG].tolist():
        out[i] = np.array_equal(raw[a[i] : a_ends[i]], raw[b[i] : b_ends[i]])
    return out


def word_spans(parts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all parts, first byte of each word, its end, number of words up to and with each part, led by 0)."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    raw = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    if lower:
        raw = _LOWER[raw]
    edge = np.flatnonzero(np.diff(_IS_SPACE[raw], prepend=True))
    starts, ends = edge[0::2], edge[1::2]
    return raw, starts, ends, np.concatenate([[0], np.searchsorted(starts, np.cumsum(sizes + 1))])


def hash_words(parts: list[bytes], lower: bool = False, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word of all parts in order, number of words up to and with each part, led by 0)."""
    raw, starts, ends, bounds = word_spans(parts, lower)
    return hash_spans(raw, starts, ends, which), bounds


def hash_runs(h: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hash of each run of n successive items: entry i covers items i .. i+n-1. Runs of 1, 2, 4, ... items are joined,
    each time through a bijection, so that no pattern of the items cancels."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    m, out, done, run, size = len(h) - n + 1, None, 0, h, 1
    while True:
        if n & size:
            part = run[done : done + m]
            out = part if out is None else mix64(out * _ODD[which] + part, which)
            done += size
        if done == n:
            return out if n > 1 else out.copy()
        run = mix64(run[:-size] * _ODD[1 - which] + run[size:], which)
        size *= 2


#: What a worker keeps between tasks: how to drop it, and when it was last used.
_kept: dict[str, tuple[Callable[[], None], float]] = {}
KEPT_S = 5.0


def keep(name: str, drop: Callable[[], None]) -> None:
    """Something kept between tasks is in use; another operator's batches drop it when it has been idle."""
    _kept[name] = (drop, time.monotonic())


def give_back() -> None:
    """Free memory of a Python worker goes back to the machine: the JVM beside it needs it."""
    for name, (drop, used) in list(_kept.items()):
        if time.monotonic() - used > KEPT_S:
            drop()
            del _kept[name]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """``edges`` (a long, b long, not null) → one row (node, component) for each node of an edge.

    Large-star / small-star rounds, each written to the scratch folder; the number of rounds is logarithmic in the
    length of chains. Stars make a hot hub's rows ``(neighbour, hub)``, so the grouping key is the neighbour and the
    hub's own group is reduced to a minimum by partial aggregation, never gathered.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    mark = _mark(e)
    while mark[0]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        big = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        lower = big.groupBy("a").agg(F.min("b").alias("low"))
        small = big.join(lower, "a").select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        e = materialize(small, tag)
        # a star forest is the fixed point: nothing changes any more
        was, mark = mark, _mark(e)
        if was == mark:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def _mark(e: DataFrame) -> tuple[int, int | None]:
    """Number and common hash of the rows."""
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


# ---------------------------------------------------------------- fixed-size membership sketches

#: Bits of a membership bitmap (8 MB), however large the data; one probe each.
SKETCH_BITS = 1 << 26
#: Keys up to which it is worth sending; beyond, the callers join instead.
SKETCH_KEYS = SKETCH_BITS // 16


def sketch(keys: DataFrame, limit: int | None = None, bits: int = SKETCH_BITS) -> np.ndarray | None:
    """A bitmap of the single long column of ``keys`` for ``in_sketch``; None if there are more than ``limit`` keys.

    It may say yes wrongly, never no, so it only thins out what a join or an exact step decides. The driver gets at
    most ``bits`` / 64 words, not the keys.
    """
    c = F.col(keys.columns[0])
    if keys.count() > (bits // 16 if limit is None else limit):
        return None
    at = F.shiftrightunsigned(F.xxhash64(c), 64 - bits.bit_length() + 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))
    words = keys.select(F.shiftright(at, 6).alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return out


def in_sketch(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = xxhash64_long(keys) >> np.uint64(64 - (64 * len(bits)).bit_length() + 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def xxhash64_long(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's ``xxhash64`` of a bigint column (the public XXH64 algorithm for 8 bytes), on arrays."""
    p1, p2, p3, p4, p5 = (np.uint64(v) for v in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
    turn = lambda v, n: v << np.uint64(n) | v >> np.uint64(64 - n)
    h = np.full(len(x), np.uint64(seed) + p5 + np.uint64(8))
    h = turn(h ^ turn(x.astype(np.int64).view(np.uint64) * p2, 31) * p1, 27) * p1 + p4
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    return h ^ h >> np.uint64(32)
