"""Operator 2: best-fit packing of documents into training sequences under several capacities.

A sequence has three capacities: tokens, number of pieces, and attention cost (sum of squared piece lengths). A
piece's demand follows from its length alone, so the histogram of lengths (at most ``capacity`` entries) is all that
the vector best-fit needs: it runs on the driver over classes of identical sequences, in bulk, in memory that doesn't
depend on the corpus. Executors rank the pieces of each length (salted, so that a common length is no hot group) and
look up their place.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, row_key, text_groups
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Capacity:
    """None: as many pieces, or as much attention, as the tokens allow anyhow."""

    tokens: int = 4096
    pieces: int | None = None
    attention: int | None = None


def tokenized_pieces(docs: DataFrame, vocabulary: str, end_id: int, longest: int, *, special: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of each document. A null text is empty and gives the end token alone; only documents longer
    than ``longest`` are cut. A null id stays null; repeated rows give repeated pieces. ``special``: see ``Encoder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, special)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for s, e, parts in text_groups(batch.column(1)):
                found, reach = enc.encode(parts)
                rows: list[tuple] = []
                for doc, a, b in zip(ids[s:e], reach, reach[1:], strict=False):
                    x = np.append(found[a:b], end_id).astype("<u4")
                    for k, at in enumerate(range(0, len(x), longest)):
                        part = x[at : at + longest]
                        rows.append((doc, k, at, len(part), zlib.crc32(part.tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def plan(histogram: dict[int, int], cap: Capacity, score: str = "norm", weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> tuple[np.ndarray, int]:
    """Vector best-fit decreasing over a histogram of lengths.

    Returns the places, one row ``(length, first rank, ranks, first sequence, pieces in each, offset)``: the pieces
    of that length with ranks from the first fill successive sequences, so many in each. And the number of sequences.
    ``score``: "norm", least weighted norm of what is left after placing; "dot", greatest weighted dot product of
    demand and residual. A sequence is eligible only if every capacity holds.
    """
    full = np.array([cap.tokens, cap.pieces or cap.tokens, cap.attention or cap.tokens**2], np.int64)
    w = np.asarray(weights, float)
    left, count, first, used = np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    places: list[tuple[int, int, int, int, int, int]] = []
    smallest = min(histogram, default=1)
    for size in sorted(histogram, reverse=True):
        n, rank, need = histogram[size], 0, np.array([size, 1, size * size], np.int64)
        if (need > full).any():
            raise ValueError(f"a piece of {size} tokens exceeds the capacities of a sequence")
        while n:
            fits = np.flatnonzero((left >= need).all(axis=1))
            if len(fits):
                x = (left[fits] - need * (score == "norm")) / full
                best = int(fits[np.argmin((w * x * x).sum(axis=1)) if score == "norm" else np.argmax((w * x * (need / full)).sum(axis=1))])
                room, have, seq = left[best].copy(), int(count[best]), int(first[best])
            else:
                best, room, have, seq = -1, full.copy(), n, used
            each = min(int((room // need).min()), n) if score == "norm" or best < 0 else 1
            bins = min(have, n // each)
            places.append((size, rank, bins * each, seq, each, int(full[0] - room[0])))
            rank, n = rank + bins * each, n - bins * each
            if best < 0:
                used += bins
            else:
                first[best] += bins
                count[best] -= bins
            rest = room - each * need
            left, count, first = np.vstack([left, rest]), np.append(count, bins), np.append(first, seq)
            keep = (count > 0) & (left[:, 0] >= smallest) & (left[:, 1] > 0) & (left[:, 2] >= smallest**2)
            left, count, first = left[keep], count[keep], first[keep]
    return np.array(places, np.int64).reshape(-1, 6), used


def pack(pieces: DataFrame, cap: Capacity = Capacity(), score: str = "norm") -> DataFrame:  # noqa: B008
    """``pieces`` (doc_id, piece, start, length, ids_crc32), each of at most ``cap.tokens`` → with sequence_id and offset.

    Every piece is placed once, sequences are gapless from offset 0, ties and repeated rows are interchangeable.
    An empty table gives an empty result.
    """
    p = materialize(pieces.select("doc_id", "piece", "start", "length", "ids_crc32"), "pieces")
    histogram = {int(r[0]): int(r[1]) for r in p.groupBy("length").count().collect()}  # at most cap.tokens rows
    places, _ = plan(histogram, cap, score)
    salts = max(64, math.isqrt(max(histogram.values(), default=0)))
    # by the row's place in the written table, so that rows that are all alike are spread, too
    salted = p.withColumn("salt", F.pmod(row_key(), F.lit(salts)))
    before = salted.groupBy("length", "salt").count().withColumn("base", F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).select("length", "salt", "base")
    ranked = salted.withColumn("nth", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))).join(before, ["length", "salt"])
    key = places[:, 0] << 44 | places[:, 1]
    order = np.argsort(key, kind="stable")
    key, table = key[order], places[order]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            row = table[np.searchsorted(key, length << 44 | rank, side="right") - 1]
            k = rank - row[:, 1]
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(row[:, 3] + k // row[:, 4]), pa.array(row[:, 5] + k % row[:, 4] * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth") - 1).alias("rank")).mapInArrow(put, PIECES + ", sequence_id long, offset long")
