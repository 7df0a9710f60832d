"""Operator 1: token ids as files: frequency-ranked, byte-aligned variable-length code, control bytes kept apart.

A folder holds ``ranks.bin`` (ids by falling frequency, little-endian u32) and shards ``PPPPPP-NNNNNN.tid`` (range of
ids, number in it) that follow each other in ascending document id. A shard: magic, number of documents, number of tokens, the documents' ids, a
byte each that tells a null id, their lengths, then control bytes (four 2-bit lengths each) and data bytes (ranks of
1 to 4 bytes). Frequent ids have small ranks and so take one byte. Decoding is numpy table lookup on whole arrays.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, row_key, scratch_path, text_groups
from .tokens import encoder

MAGIC = b"STONEID1"
#: Tokens that a shard should hold; a longer document still stays whole.
SHARD_TOKENS = 4_000_000
#: Tokens of a range of ids, on average, that a task sorts and writes; it holds one shard of them at a time.
RANGE_TOKENS = 16_000_000

_CODES = np.arange(256, dtype=np.uint8)
_LENGTHS = np.stack([(_CODES >> s & 3) + 1 for s in (0, 2, 4, 6)], axis=1)  # of the four values behind a control byte


def encode_values(x: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of non-negative 32-bit values."""
    x = x.astype("<u4")
    size = 1 + (x > 0xFF) + (x > 0xFFFF) + (x > 0xFFFFFF)
    code = np.zeros(-(-len(x) // 4) * 4, np.uint8)
    code[: len(x)] = size - 1
    q = code.reshape(-1, 4)
    control = q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6
    keep = np.arange(4) < size[:, None]
    return control.astype(np.uint8).tobytes(), x.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def decode_values(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    size = _LENGTHS[control].reshape(-1)[:n].astype(np.int64)
    at = np.cumsum(size) - size
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    out = padded[at].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        more = size > k
        out[more] |= padded[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def shard_bytes(ids: list[int | None], lengths: list[int], ranks: np.ndarray) -> bytes:
    control, data = encode_values(ranks)
    head = np.array([len(ids), len(ranks)], "<u8").tobytes()
    return b"".join([MAGIC, head, np.array([i or 0 for i in ids], "<i8").tobytes(), bytes(i is None for i in ids), np.array(lengths, "<u8").tobytes(), control, data])


def read_shard(raw: bytes, by_rank: np.ndarray) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, lengths, token ids of all documents in a row)."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token shard")
    docs, n = (int(v) for v in np.frombuffer(raw, "<u8", 2, 8))
    at = 24
    ids, at = np.frombuffer(raw, "<i8", docs, at), at + 8 * docs
    null, at = raw[at : at + docs], at + docs
    lengths, at = np.frombuffer(raw, "<u8", docs, at).astype(np.int64), at + 8 * docs
    control = np.frombuffer(raw, np.uint8, -(-n // 4), at)
    data = np.frombuffer(raw, np.uint8, offset=at + len(control))
    return [None if z else int(i) for i, z in zip(ids, null, strict=True)], lengths, by_rank[decode_values(control, data, n)]


def _open(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, folder: str, *, special: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise every whole text, append ``end_id`` and write the shards to ``folder`` (a URI that executors share).

    Returns the shards: part, nth, path, n_docs, n_tokens. A null text is empty; null ids come first; repeated rows are
    written repeatedly, and rows of one id may go on from shard to shard. An empty table writes no shard. A shard gets
    its name by a move after it is whole, so a repeated task replaces it by the same bytes. ``special``: see ``Encoder``.
    """

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, special)
        width = enc.dtype.itemsize
        for batch in batches:
            for s, e, parts in text_groups(batch.column(1)):
                found, reach = enc.encode(parts)
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), e - s, [None, pa.py_buffer((reach * width).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(found))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), ids, pa.array(np.diff(reach) + 1)], names=["doc_id", "ids", "n"])

    width = encoder(vocabulary, special).dtype
    size = max(encoder(vocabulary, special).vocabulary, end_id + 1)
    raw = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tokenize, "doc_id long, ids binary, n long"), "token-ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), width), minlength=size)
            total[end_id] += b.num_rows
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "c"])

    counts = raw.select("ids").mapInArrow(count, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).collect()  # as many rows as the vocabulary at most
    frequency = np.zeros(size, np.int64)
    for i, c in counts:
        frequency[i] = c
    by_rank = np.argsort(-frequency, kind="stable")
    rank = np.empty(size, np.uint32)
    rank[by_rank] = np.arange(size, dtype=np.uint32)
    fs, root = _open(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/ranks.bin") as f:
        f.write(by_rank.astype("<u4").tobytes())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, target = _open(folder)
        part, nth = TaskContext.get().partitionId(), 0
        ids, lengths, raws, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            name = f"{part:06d}-{nth:06d}.tid"
            temporary = f"{target}/.{name}-{uuid.uuid4().hex}"
            found = np.frombuffer(b"".join(raws), width)
            at = np.cumsum(lengths)
            tokens = np.full(held, rank[end_id], np.uint32)  # the last of each document stays
            own = np.ones(held, bool)
            own[at - 1] = False
            tokens[own] = rank[found]
            with out.open_output_stream(temporary) as f:
                f.write(shard_bytes(ids, lengths, tokens))
            out.move(temporary, f"{target}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([nth], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([len(ids)]), pa.array([held])], names=["part", "nth", "path", "n_docs", "n_tokens"])

        for b in batches:
            for doc, x, n in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if ids and held + n > SHARD_TOKENS:
                    yield close()
                    ids, lengths, raws, held, nth = [], [], [], 0, nth + 1
                ids.append(doc)
                lengths.append(n)
                raws.append(x)
                held += n
        if ids:
            yield close()

    ranges = max(1, -(-int(frequency.sum()) // RANGE_TOKENS))
    # a row's place as a second key, so that rows of one id, or of none, can be dealt to several ranges
    keyed = raw.select("doc_id", "ids", "n", row_key().alias("place"))
    order = [F.asc_nulls_first("doc_id"), F.asc("place")]
    dealt = keyed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("doc_id", "ids", "n")
    return materialize(dealt.mapInArrow(write, "part int, nth int, path string, n_docs long, n_tokens long"), "token-shards")


def read_token_files(spark: SparkSession, shards: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        with fs.open_input_stream(f"{root}/ranks.bin") as f:
            by_rank = np.frombuffer(f.read(), "<u4")
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{root}/{path.rsplit('/', 1)[1]}") as f:
                    ids, lengths, tokens = read_shard(f.read(), by_rank)
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(tokens[e - n : e].astype("<u4").tobytes()) for e, n in zip(ends, lengths, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(base + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # shards before one: those of earlier ranges, one row a range, and earlier ones of its own
    per = shards.groupBy("part").agg(F.sum("n_tokens").alias("all"))
    per = per.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    own = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("nth")) - F.col("n_tokens")
    placed = shards.withColumn("own", own).join(F.broadcast(per), "part").select("path", (F.col("before") + F.col("own")).alias("base"))
    tasks = max(1, min(shards.count(), 4 * spark.sparkContext.defaultParallelism))
    return placed.repartition(tasks).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, *, special: bool = True) -> DataFrame:
    folder = folder or scratch_path(docs.sparkSession, "token-files")
    return read_token_files(docs.sparkSession, write_token_files(docs, vocabulary, end_id, folder, special=special), folder)
