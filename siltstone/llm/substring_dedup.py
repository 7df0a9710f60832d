"""Operator 5: removing long passages that repeat across documents, by suffix automata of reference shards.

Each shard's automaton holds whole-word passages of many documents and knows, for each of its states, the least document
that holds the state's words. Passages are streamed through it for their matching statistics: where these reach
``window`` words, the state of the last ``window`` words tells the least document in which they also start, and maximal
spans of such windows under a smaller document go.

Sending each automaton to every document would cost shards x documents, so hashes thin out and route what is streamed;
they decide nothing. A window of words is known by its least k-gram (every copy of the window picks the same one):
windows whose k-gram was picked in one document alone are in no other. Windows left whose own hash is in one document
alone are in no other, either. Each passage of the rest goes to the shard of the least document with its hashes, to
which all its copies go as well, and where all passages together, whoever holds them, make up the automaton. If hashes
of different words agree, strangers meet in a shard, and the automaton, which compares words, keeps them apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_runs, hash_words, in_sketch, materialize, sketch, text_groups, texts

#: Stands for a null id: larger than all others but this one, with which it ranks equal.
LAST = 2**63 - 1
#: Passages that a task streams through one automaton, about, and different ones of an owner from which its shard is
#: copied, each copy to stream a part of them.
TASK_PASSAGES, COPY_PASSAGES = 1000, 20_000


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n, size = len(x) - w + 1, 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[w - size : w - size + n])


def window_anchors(h: np.ndarray, bounds: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each window within one document, position of its least k-gram, hashes of all k-grams)."""
    if len(h) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = hash_runs(h, k)
    order = g >> np.uint64(32) << np.uint64(32) | np.arange(len(g), dtype=np.uint64)
    at = (sliding_min(order, window - k + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    first = np.flatnonzero(np.arange(len(at)) + window <= ends[: len(at)])
    return first, at[first], g


class Automaton:
    """Suffix automaton of word sequences; each state knows the least document that holds its words."""

    def __init__(self, passages: list[tuple[int, list[bytes]]]):
        self.next: list[dict] = [{}]
        self.link, self.len, self.low = [-1], [0], [LAST]
        nxt, link, length, low = self.next, self.link, self.len, self.low
        for doc, words in passages:
            last = 0
            for w in words:
                got = nxt[last].get(w)
                if got is not None and length[got] == length[last] + 1:
                    last = got
                    low[last] = min(low[last], doc)
                    continue
                if got is not None:
                    clone = self._clone(last, w, got)
                    last = clone
                    low[last] = min(low[last], doc)
                    continue
                cur = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                low.append(doc)
                link.append(0)
                p = last
                while p != -1 and w not in nxt[p]:
                    nxt[p][w] = cur
                    p = link[p]
                if p != -1:
                    q = nxt[p][w]
                    link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
                last = cur
        for v in sorted(range(1, len(nxt)), key=length.__getitem__, reverse=True):
            if low[v] < low[link[v]]:
                low[link[v]] = low[v]

    def _clone(self, p: int, w: bytes, q: int) -> int:
        nxt, link = self.next, self.link
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        self.len.append(self.len[p] + 1)
        self.low.append(LAST)
        link.append(link[q])
        link[q] = clone
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        return clone

    def spans(self, words: list[bytes], window: int) -> list[list[int]]:
        """[from, to, least document] for maximal spans of successive windows that start in the same least document."""
        nxt, link, length, low = self.next, self.link, self.len, self.low
        v = n = 0
        out: list[list[int]] = []
        for i, w in enumerate(words, 1):
            while v and w not in nxt[v]:
                v = link[v]
                n = length[v]
            to = nxt[v].get(w)
            if to is None:
                v = n = 0
                continue
            v, n = to, n + 1
            if n >= window:
                while length[link[v]] >= window:
                    v = link[v]
                n = window
                if out and out[-1][2] == low[v] and out[-1][1] == i - 1:
                    out[-1][1] = i
                else:
                    out.append([i - window, i, low[v]])
        return out


def _batch(names: list[str], cols: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=names)


def dedup_passages(docs: DataFrame, window: int = 50, gram: int = 16, *, id_col: str = "doc_id", text_col: str = "text", sketch_keys: int | None = None) -> DataFrame:
    """doc_id, text (the words that stay, joined by one space), n_words, n_removed, spans (array of first word and
    end of what goes).

    A window of ``window`` successive words goes if the same words also start in a document with a smaller id,
    judged on the input. Null texts have no words; a null id ranks as 2^63-1, the largest; rows sharing an id are one
    document (of which each row has its own text), so repeated rows don't remove each other. Texts shorter than a window
    stay. Other columns of ``docs`` don't matter. ``sketch_keys``: keys up to which bitmaps are sent to spare a join
    (tests set 0).
    """
    spark = docs.sparkSession
    gram = min(gram, window)
    limit = {} if sketch_keys is None else {"limit": sketch_keys}
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), text.alias("text"), F.xxhash64(text).alias("of"), F.col(id_col).cast("long").alias("doc_id"))

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, e, parts in text_groups(b.column(1)):
                ids = b.column(0).to_numpy()[s:e]
                h, bounds = hash_words(parts)
                first, at, g = window_anchors(h, bounds, window, gram)
                doc = np.searchsorted(bounds, first, side="right") - 1
                new = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
                yield _batch(["a", "id"], [g[at[new]].view(np.int64), ids[doc[new]]])

    anchors = d.select("id", "text").mapInArrow(picked, "a long, id long")
    shared = materialize(anchors.groupBy("a").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("a"), "anchors")
    bits = sketch(shared, **limit)
    if bits is None:
        lists = anchors.join(shared, "a").groupBy("id").agg(F.collect_set("a").alias("anchors"))
        d_near, known = d.select("id", "text", "of").join(lists, "id").select("id", "text", "of", "anchors"), None
    else:
        d_near, known = d.select("id", "text", "of"), spark.sparkContext.broadcast(bits)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, e, parts in text_groups(b.column(1)):
                ids = b.column(0).to_numpy()[s:e]
                h, bounds = hash_words(parts)
                first, at, g = window_anchors(h, bounds, window, gram)
                doc = np.searchsorted(bounds, first, side="right") - 1
                if known is not None:
                    near = in_sketch(known.value, g[at].view(np.int64))
                else:
                    near = np.zeros(len(first), bool)
                    for i, own in enumerate(b.column(3).slice(s, e - s).to_pylist()):
                        m = doc == i
                        near[m] = np.isin(g[at[m]].view(np.int64), np.array(own, np.int64))
                first, doc = first[near], doc[near]
                wh = hash_runs(h, window)[first] if len(first) else np.zeros(0, np.uint64)
                of = b.column(2).to_numpy()[s:e]
                yield _batch(["w", "id", "of", "first"], [wh.view(np.int64), ids[doc], of[doc], (first - bounds[doc]).astype(np.int32)])

    seen = d_near.mapInArrow(windows, "w long, id long, of long, first int")
    # written, so that the join below gets its own exchanges, and a window found everywhere can be split among tasks
    owned = materialize(seen.groupBy("w").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("w", "low"), "owners-of-windows")
    # first word and owner packed in one list for each document
    marks = materialize(seen.join(owned, "w").groupBy("id", "of").agg(F.sort_array(F.collect_set(F.struct("first", "low"))).alias("marks")).select("id", "of", "marks.first", "marks.low"), "marks")
    doc_bits = sketch(marks.select("id"), **limit)
    held = None if doc_bits is None else spark.sparkContext.broadcast(doc_bits)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b if held is None else b.filter(pa.array(in_sketch(held.value, b.column(0).to_numpy())))

    some = d.mapInArrow(marked, "id long, text string, of long, doc_id long")

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.string())
        for b in batches:
            for s, e, parts in text_groups(b.column(1)):
                rows: list[tuple] = []
                for doc, text, of, first, low in zip(b.column(0).slice(s, e - s).to_pylist(), parts, *(b.column(k).slice(s, e - s).to_pylist() for k in (2, 3, 4)), strict=True):
                    words = text.split()
                    f, o = np.array(first), np.array(low)
                    cut = np.flatnonzero((np.diff(f) != 1) | (np.diff(o) != 0)) + 1
                    for i, j in zip([0, *cut], [*cut, len(f)], strict=True):
                        passage = b" ".join(words[f[i] : f[j - 1] + window])
                        rows.append((int(o[i]), doc, of, int(f[i]), hashlib.blake2b(passage, digest_size=16).digest(), passage.decode()))
                yield _batch(["owner", "id", "of", "at", "key", "passage"], [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)])

    found = materialize(some.join(marks, ["id", "of"]).select("id", "text", "of", "first", "low").mapInArrow(passages, "owner long, id long, of long, at int, key binary, passage string"), "passages")
    # equal passages of an owner's shard are streamed once, and held once by their least document
    known_as = found.groupBy("owner", "key", "passage").agg(F.min("id").alias("least"))
    once = materialize(known_as, "different-passages")
    load = materialize(once.groupBy("owner").agg(F.ceil(F.count("*") / COPY_PASSAGES).cast("int").alias("copies"), F.count("*").alias("n")), "owners")
    total = load.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, -(-total // TASK_PASSAGES))
    dealt = once.join(load, "owner").withColumn("own", F.pmod(F.xxhash64("key"), F.col("copies")).cast("int"))
    dealt = dealt.select(F.pmod(F.xxhash64("owner"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "own", "owner", "key", "passage", "least")

    def stream(t: pa.Table) -> pa.Table:
        t = t.sort_by([("least", "ascending"), ("key", "ascending")])
        held = [x.split() for x in texts(t.column("passage").combine_chunks())]
        least = t.column("least").to_pylist()
        automaton = Automaton(list(zip(least, held, strict=True)))
        out: list[tuple] = []
        for owner, key, words, ask in zip(t.column("owner").to_pylist(), t.column("key").to_pylist(), held, np.equal(t.column("own").to_numpy(), t.column("copy").to_numpy()).tolist(), strict=True):
            if ask:
                out += [(owner, key, *x) for x in automaton.spans(words, window)]
        cols = list(zip(*out, strict=True)) or [[]] * 5
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["owner", "key", "first", "end", "low"])

    matched = dealt.groupBy("shard", "copy").applyInArrow(stream, "owner long, key binary, first long, end long, low long")
    matched = materialize(matched, "matched")
    spans = found.select("owner", "key", "id", "of", "at").join(matched, ["owner", "key"]).where("low < id")
    spans = spans.select("id", "of", (F.col("at") + F.col("first")).alias("first"), (F.col("at") + F.col("end")).alias("end"))
    spans = spans.groupBy("id", "of").agg(F.sort_array(F.collect_set(F.struct("first", "end"))).alias("spans")).select("id", "of", "spans.first", "spans.end")

    schema = "doc_id long, text string, n_words long, n_removed long, spans array<struct<first: long, end: long>>"
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def kept(ids: pa.Array, rows: Iterator[tuple]) -> pa.RecordBatch:
        done = []
        for text, first, end in rows:
            words, merged = text.split(), []
            for s, e in zip(first or (), end or (), strict=True):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            stay, at = [], 0
            for s, e in merged:
                stay += words[at:s]
                at = e
            stay += words[at:]
            done.append((b" ".join(stay).decode(), len(words), len(words) - len(stay), [{"first": s, "end": e} for s, e in merged]))
        cols = list(zip(*done, strict=True)) or [[]] * 4
        return _batch(["doc_id", "text", "n_words", "n_removed", "spans"], [ids, *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), kind), strict=True))])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, e, parts in text_groups(b.column(1)):
                yield kept(b.column(0).slice(s, e - s), zip(parts, *(b.column(k).slice(s, e - s).to_pylist() for k in (2, 3)), strict=True))

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(~in_sketch(held.value, b.column(0).to_numpy())))
            for s, e, parts in text_groups(b.column(1)):
                yield kept(b.column(2).slice(s, e - s), ((t, None, None) for t in parts))

    touched = some.join(spans, ["id", "of"], "left").select("doc_id", "text", "first", "end").mapInArrow(finish, schema)
    return touched if held is None else touched.union(d.select("id", "text", "doc_id").mapInArrow(untouched, schema))
