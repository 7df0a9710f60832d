"""Operator 10: mixing sources to target weights by Pareto order sampling.

Within a source a document's expected number of copies grows with its weight, by default the square root of its size.
The whole part is certain; for the rest documents are ranked by their random odds divided by the odds of that rest, and
those before a cut in this order are taken, so that the source's words come to its target. The cut is found by a
histogram of ranks, so no source is gathered: only the documents of the one histogram bucket in which the cut falls meet
in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_groups, uniform

#: Documents that the bucket of the cut holds on average, as long as a source needs no more than MOST_BUCKETS.
CUT_DOCS = 512
MOST_BUCKETS = 1 << 16
#: Weights are rounded to this many steps for each power of two, so that a source has few different ones.
STEPS = 8
#: Share of a target by which its source may miss it before documents near the cut are passed over or exchanged.
NEAR = 0.005


def sized(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size (the number of words of the whole text, 0 for a null) and key (a hash of the text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, e, parts in text_groups(b.column(2)):
                n = [len(x.split()) for x in parts]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), b.column(1).slice(s, e - s), pa.array(n, pa.int64()), b.column(3).slice(s, e - s)], names=["doc_id", "source", "size", "key"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("key"))
    return d.mapInArrow(count, "doc_id long, source string, size long, key long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), limit: float = 3.0) -> DataFrame:
    """Per source (by code point, null last): source_size and target.

    The weights repeat over the sources and share out all sizes. A target stops at ``limit`` times its source's size
    and the excess goes to the others by weight: with sources in order of limit*size/weight, those before the point
    where a common level covers all others are full. One row a source, by windows.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights))
    per = per.withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(float(limit)))
    rise = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    whole = Window.partitionBy()
    per = per.withColumn("full_before", F.coalesce(F.sum("most").over(rise.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    per = per.withColumn("weight_from", F.sum("weight").over(rise.rowsBetween(0, Window.unboundedFollowing)))
    per = per.withColumn("level", (F.sum("source_size").over(whole) - F.col("full_before")) / F.col("weight_from"))
    # levels rise as long as sources are full and fall behind the first that isn't
    per = per.withColumn("common", F.max("level").over(whole))
    return per.select("source", "source_size", "n", F.coalesce(F.least(F.col("common") * F.col("weight"), F.col("most")), F.lit(0.0)).alias("target"))


def exchange(size: np.ndarray, copies: np.ndarray, left: float, limit: float) -> tuple[int, int | None] | None:
    """The document to take once more, and perhaps one to take once less, so that ``left`` comes nearest to 0; None if
    no such change makes it smaller by a tenth."""
    out, best = None, 0.9 * abs(left)
    given = np.flatnonzero(copies > 0)
    given = given[np.argsort(size[given], kind="stable")]
    for i in np.flatnonzero(copies + 1 <= limit).tolist():
        at = int(np.searchsorted(size[given], size[i] - left))
        for back in (None, *(int(given[k]) for k in (at - 1, at) if 0 <= k < len(given))):
            if (miss := abs(left - size[i] + (0 if back is None else size[back]))) < best:
                out, best = (i, back), miss
    return out


def _same(a: str, b: str) -> F.Column:
    return F.col(a).eqNullSafe(F.col(b))


def factors(rows: DataFrame, per: DataFrame, limit: float) -> DataFrame:
    """Per source s: the factor by which weights become expected copies, ``limit`` at most, that add up to its target.

    As in ``targets``: with a source's weights in falling order, those before the point where a common factor covers
    the target are at the limit. A row for each source and rounded weight.
    """
    by = rows.groupBy("source", "w").agg(F.sum("size").alias("words")).withColumnRenamed("source", "s")
    by = by.join(per.select("source", "target"), _same("s", "source"))
    fall = Window.partitionBy("s").orderBy(F.desc("w"))
    full = F.coalesce(F.sum("words").over(fall.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * F.lit(float(limit))
    mass = F.sum(F.col("words") * F.col("w")).over(fall.rowsBetween(0, Window.unboundedFollowing))
    by = by.withColumn("level", (F.col("target") - full) / F.when(mass > 0, mass))
    return by.groupBy("s").agg(F.coalesce(F.max("level"), F.lit(0.0)).alias("factor"))


def mix(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), limit: float = 3.0, seed: int = 17, weight_col: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken.

    ``sizes``: doc_id, source, size, perhaps key (tells documents of one id or none apart) and a positive ``weight_col``
    in proportion to which expected copies within a source differ (to the nearest of STEPS steps a power of two; by
    default the square root of the size). A document is taken 0 to ``limit`` (a whole number) times; ``taken`` = copies
    * size. What is taken is a prefix of the order that comes as near to the target as can be; only where it misses by
    more than NEAR of the target, for very long documents at the cut of a small source, are some passed over or exchanged. Documents without
    words are taken with the least odds and add nothing. Reruns agree: the random number of a document follows from its
    id, size, key and the seed; repeated rows are numbered. Ids pass through unchanged, null ones too. A null source is
    a source of its own.
    """
    w = F.col(weight_col).cast("double") if weight_col else F.sqrt(F.greatest(F.col("size"), F.lit(1)))
    w = F.pow(F.lit(2.0), F.round(F.log2(w) * STEPS) / STEPS)
    key = F.col("key") if "key" in sizes.columns else F.lit(0).cast("long")
    rows = sizes.select("doc_id", "source", "size", key.alias("key"), w.alias("w")).groupBy("doc_id", "source", "size", "key", "w").agg(F.count("*").alias("many"))
    rows = materialize(rows.select("doc_id", "source", "size", "key", "w", F.explode(F.sequence(F.lit(1).cast("long"), "many")).alias("nth")), "sizes")
    per = materialize(targets(rows, weights, limit), "targets")
    per = materialize(per.join(factors(rows, per, limit), _same("source", "s")).drop("s"), "factors")
    few = per.count() <= 100_000  # else the sources themselves are many, and Spark joins as it sees fit
    buckets = F.least(F.lit(MOST_BUCKETS), F.greatest(F.lit(1), F.pow(F.lit(2.0), F.floor(F.log2(F.col("n") / CUT_DOCS))))).cast("int")
    per = per.select(F.col("source").alias("s"), "source_size", "target", "factor", buckets.alias("buckets"))
    d = rows.join(F.broadcast(per) if few else per, _same("source", "s")).drop("s")
    copies = F.least(F.lit(float(limit)), F.col("factor") * F.col("w"))
    d = d.withColumn("certain", F.floor(copies + 1e-9).cast("long")).withColumn("p", F.greatest(copies - F.col("certain"), F.lit(0.0)))
    u = uniform(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "size", "key", "nth", seed=seed)
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    # odds/(1+odds) keeps the order and lies in (0, 1)
    share = F.col("rank") / (1 + F.col("rank"))
    d = d.withColumn("rank", F.when(F.col("p") > 0, odds)).withColumn("bucket", F.least(F.floor(share * F.col("buckets")).cast("int"), F.col("buckets") - 1))
    base = d.groupBy("source", "target").agg(F.sum(F.col("certain") * F.col("size")).alias("sure"))
    hist = d.where("bucket is not null").groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    hist = hist.select(F.col("source").alias("hs"), "bucket", "words")
    run = hist.join(base, _same("hs", "source")).withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words"))
    run = run.withColumn("gap", F.col("target") - F.col("sure") - F.col("before"))
    cut = run.where("gap > 0").groupBy("source").agg(F.max_by(F.struct("bucket", "gap"), "bucket").alias("x")).select(F.col("source").alias("cs"), F.col("x.bucket").alias("cut"), F.col("x.gap").alias("gap"))
    cut = materialize(cut, "cuts")
    d = d.join(F.broadcast(cut) if few else cut, _same("source", "cs"), "left").drop("cs")
    out = ["doc_id", "source", "size", "source_size", "target", "copies"]
    done = d.where("bucket is null or cut is null or bucket <> cut").withColumn("copies", F.col("certain") + F.when(F.col("bucket") < F.col("cut"), 1).otherwise(0)).select(*out)

    def fill(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("rank", "doc_id", "size", "key", "nth")])
        size, left = t.column("size").to_numpy(), t.column("gap")[0].as_py()
        near = NEAR * t.column("target")[0].as_py()
        copies = t.column("certain").to_numpy().copy()
        for i, n in enumerate(size.tolist()):
            if n <= left:
                copies[i], left = copies[i] + 1, left - n
            elif min(left, n - left) <= near:
                if n - left < left:
                    copies[i], left = copies[i] + 1, left - n
                break
        while abs(left) > near and (change := exchange(size, copies, left, limit)):
            for i, more in zip(change, (1, -1), strict=True):
                if i is not None:
                    copies[i], left = copies[i] + more, left - more * size[i]
        return t.select(out[:-1]).append_column("copies", pa.array(copies))

    edge = d.where("bucket = cut").select("doc_id", "source", "size", "source_size", "target", "certain", "rank", "gap", "key", "nth")
    filled = edge.groupBy("source").applyInArrow(fill, "doc_id long, source string, size long, source_size long, target double, copies long")
    return done.union(filled).withColumn("taken", F.col("copies") * F.col("size"))
