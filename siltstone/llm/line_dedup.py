"""Operator 6: line deduplication across documents, in DataFrame functions only.

Lines are exploded without their text: a key's hash, the document and the position. Each hash is reduced to its
smallest document before anything meets (a line found everywhere costs one row for each task), only repeated hashes
are joined back, and each document gets the short list of positions that it loses; its text is cut at those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, materialize


def dedup_lines(docs: DataFrame, min_chars: int = 10, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``text_col`` replaced, as column ``row``; beside it n_lines and n_dropped.

    A line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys of ``min_chars`` code
    points or more lose all their lines outside the smallest document that holds them. A null text counts as one
    empty line and becomes the empty string. A null id counts as larger than all others; rows that share an id are
    one document, so repeated rows keep equal lines. Other columns, whatever their names, pass through in ``row``.
    """
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("print", F.xxhash64("text"))
    lines = d.select("id", "print", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.select("id", "print", "pos", ascii_lower(F.trim(F.col("line"), F.lit(SPACE))).alias("key")).where(F.char_length("key") >= min_chars)
    # two hashes of different seeds (the first argument sets the second's): 128 bits, so that of 1e12 different lines two
    # agree with odds of 1e-15
    hashed = keys.select("id", "print", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    # written, so that the join below gets its own exchanges, and a line found everywhere can be split among tasks
    first = materialize(hashed.groupBy("h1", "h2").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max(F.col("id").isNull()).alias("unnamed")).where("low < high or (low is not null and unnamed)").select("h1", "h2", "low"), "repeated-lines")
    gone = hashed.join(first, ["h1", "h2"]).where("id > low or id is null").groupBy("id", "print").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    gone = gone.select(F.col("id").alias("gone_id"), F.col("print").alias("gone_print"), "gone")
    met = d.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("print") == F.col("gone_print")), "left")
    cut = met.select("row", "gone", "text", F.split("text", "\n", -1).alias("lines"))
    # what stands between two positions that go, and before the first and behind the last
    spans = F.transform(
        F.sequence(F.lit(0), F.size("gone")),
        lambda j: F.slice(
            F.col("lines"),
            F.when(j == 0, 1).otherwise(F.get(F.col("gone"), j - 1) + 2),
            F.when(j == F.size("gone"), F.size("lines")).otherwise(F.get(F.col("gone"), j)) - F.when(j == 0, 0).otherwise(F.get(F.col("gone"), j - 1) + 1),
        ),
    )
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(spans), "\n"))
    return cut.select(F.col("row").withField(f"`{text_col}`", kept).alias("row"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
