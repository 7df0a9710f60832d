"""Operator 4: a quality classifier by importance resampling.

Two generative models of hashed word n-grams (1 and 2 words): one of the target texts (documents labelled good), one
of all raw texts. A document's importance weight is the ratio of its two likelihoods, its key the log weight plus Gumbel
noise. The k greatest keys are the sample: a draw without replacement with chances in proportion to the weights. The
n-grams of a document are far from independent, so one with more than EFFECTIVE of them counts as that many: else the
weights of long documents would be hundreds of nats apart, and noise of one or two nats would decide nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import about, hash_runs, hash_words, materialize, text_groups, uniform

BITS = 16
#: Labelled documents used on average, half of them to fit the target model and half to set k; by hash of the id.
MOST_LABELS = 50_000
#: Share of the good labelled documents that may fall below the weight from which k is counted.
LOSS = 0.005
#: Independent n-grams that a document counts as, at most.
EFFECTIVE = 64
#: Keys that the driver sorts to find the last one taken.
SORTED_KEYS = 100_000


def grams(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each word and each pair of words."""
    h, bounds = hash_words(parts)
    row = np.repeat(np.arange(len(parts)), np.diff(bounds))
    two = hash_runs(h, 2)
    inside = row[: len(two)] == row[1:][: len(two)]
    shift = np.uint64(64 - BITS)
    return np.concatenate([row, row[: len(two)][inside]]), (np.concatenate([h, two[inside]]) >> shift).astype(np.int64)


def kth_key(keys: DataFrame, k: int, rows: int, most: int = SORTED_KEYS) -> tuple[float, int | None]:
    """(key, id) of the k-th greatest of (key, id): narrowed down by histograms until few keys are left to sort."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    part, rank, left = keys, k, rows
    while left > most and low < high:
        step = (high - low) / 65536
        cell = F.least(F.lit(65535), F.floor((F.col("key") - low) / step)).cast("int")
        counts = {r[0]: r[1] for r in part.groupBy(cell.alias("c")).count().collect()}  # 65536 rows at most
        for c in sorted(counts, reverse=True):
            if rank <= counts[c]:
                break
            rank -= counts[c]
        part, left = part.where(cell == c), counts[c]
        was = (low, high)
        low, high = part.agg(F.min("key"), F.max("key")).first()
        if (low, high) == was:
            break
    at = part.orderBy(F.desc("key"), F.asc_nulls_last("doc_id")).limit(rank).orderBy("key", F.desc_nulls_first("doc_id")).first()
    return at["key"], at["doc_id"]


def resample(docs: DataFrame, labels: DataFrame, seed: int = 23, effective: int = EFFECTIVE, loss: float = LOSS, k: int | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_grams, log_weight (null without words), key and kept, for every document.

    ``labels``: doc_id and quality (1 good, 0 bad; null ignored; the least counts among repeated ones). Without ``k``
    it is the number of documents whose log weight reaches that of all but ``loss`` of the good labelled documents
    held out from the fit; without such labels, all documents with words. Texts null or without words are never kept.
    A null id is no labelled one. Among equal keys the smaller id goes first, a null id last; the noise of a document
    follows from its id, so repeated rows share their keys and all stay if one does.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"))
    good = np.sort(np.array([r[0] for r in about(named, "doc_id", MOST_LABELS, seed).where("q = 1").select("doc_id").collect()], np.int64))
    odds = np.random.default_rng(seed).random(len(good)) < 0.5
    fit, held = good[odds], good[~odds]
    shared = spark.sparkContext.broadcast((fit, held))

    def member(ids: pa.Array, of: np.ndarray) -> np.ndarray:
        x, known = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)
        return known & (of[np.minimum(np.searchsorted(of, x), len(of) - 1)] == x) if len(of) else np.zeros(len(x), bool)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for b in batches:
            wanted = member(b.column(0), shared.value[0])
            for s, e, parts in text_groups(b.column(1)):
                row, g = grams(parts)
                raw += np.bincount(g, minlength=1 << BITS)
                target += np.bincount(g[wanted[s:e][row]], minlength=1 << BITS)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(target[seen])], names=["g", "r", "t"])

    counts = d.mapInArrow(count, "g long, r long, t long").groupBy("g").agg(F.sum("r").alias("r"), F.sum("t").alias("t")).toArrow()  # 65536 rows at most
    raw, target = np.zeros(1 << BITS), np.zeros(1 << BITS)
    raw[counts.column("g").to_numpy()], target[counts.column("g").to_numpy()] = counts.column("r").to_numpy(), counts.column("t").to_numpy()
    extra = max(target.sum(), 1.0) / max(raw.sum(), 1.0)  # of the target model, as 1 is of the raw one
    ratio = np.log((target + extra) / (target.sum() + extra * len(raw))) - np.log((raw + 1) / (raw.sum() + len(raw)))
    ratio = spark.sparkContext.broadcast(ratio if len(fit) else np.zeros_like(ratio))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            test = member(b.column(0), shared.value[1])
            for s, e, parts in text_groups(b.column(1)):
                row, g = grams(parts)
                n = np.bincount(row, minlength=e - s)
                total = np.bincount(row, weights=ratio.value[g], minlength=e - s)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), pa.array(n, pa.int64()), pa.array(total * np.minimum(1, effective / np.maximum(n, 1)), mask=n == 0), pa.array(test[s:e])], names=["doc_id", "n_grams", "log_weight", "held_out"])

    weighed = materialize(d.mapInArrow(weigh, "doc_id long, n_grams long, log_weight double, held_out boolean"), "weights")
    gumbel = -F.log(-F.log(uniform(F.lit("gumbel"), F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), seed=seed)))
    keyed = weighed.withColumn("key", F.col("log_weight") + gumbel)
    if k is None:
        sample = np.sort(np.array([r[0] for r in weighed.where("held_out and log_weight is not null").select("log_weight").collect()]))
        least = float(sample[int(loss * len(sample))]) if len(sample) else -np.inf
        k = weighed.where(F.col("log_weight") >= F.lit(least)).count()
    keys = keyed.where("key is not null").select("doc_id", "key")
    rows = keys.count()
    k = min(k, rows)
    if k <= 0:
        kept = F.lit(False)
    else:
        edge, last = kth_key(keys, k, rows)
        tie = F.lit(True) if last is None else F.col("doc_id") <= F.lit(last)
        kept = F.coalesce((F.col("key") > F.lit(edge)) | ((F.col("key") == F.lit(edge)) & F.coalesce(tie, F.lit(False))), F.lit(False))
    return keyed.select("doc_id", "n_grams", "log_weight", "key", kept.alias("kept"))
