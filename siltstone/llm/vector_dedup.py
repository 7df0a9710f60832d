"""Operator 8: near-duplicate vectors by a robust-pruned flat graph.

Equal vectors are one node. Nodes are dealt to overlapping clusters of their label (the OVERLAP nearest centres, fit on
a bounded sample; every node is indexed). Clusters that are still larger than a task should hold are split again, by
centres fit on a sample of their own, and what no centres can split (a mass of almost equal vectors) is cut into blocks.
A task builds a shard's graph: each node's nearest ones, thinned by robust pruning, and reverse edges; a node's lists
from all its shards are united. Then every node searches the shard of its nearest centre, greedily from the medoid, and
once inside the range expands everything in it. What it reaches is compared in double precision.

A group of near copies has links by the square of its size, so links leave no task: each gives a node's number of links,
and one edge from each linked node to the least one that it is connected with in the task.

The audit compares the number of links with brute force for all nodes holding an id divisible by 20. Links found have
passed the comparison, so they are among the true ones, and the quotient of the numbers is the recall. Below LEAST_RECALL
the search is done again with wider overlap and beam.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, uniform

#: Vectors, on average, from which the first centres are fit, and those of a cluster that is split again.
SAMPLE, CELL_SAMPLE = 20_000, 1024
#: Nodes that a cluster should have, and that a block of one may have.
CELL, BLOCK = 300, 1000
#: Rounds of splitting, and clusters that one becomes at most.
ROUNDS, SPLIT = 5, 16
OVERLAP = 3
DEGREE, POOL, BEAM, ALPHA = 24, 64, 32, 1.2
#: Nodes that a query expands at once.
EXPANDED = 8
LEAST_RECALL = 0.95
#: Rows that a task deals out, or compares in the audit.
CHUNK = 4000


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """To length 1; scaled first, so that neither squares nor sums leave the range of doubles."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def centres(x: np.ndarray, k: int, apart: float, rounds: int = 8) -> np.ndarray:
    """Spherical k-means, from the first k rows (given in random order). Of centres whose product is over ``apart`` one
    stays: near copies, however many, are not to be dealt to different cells."""
    c = x[:k].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        for j in np.unique(near):
            s = x[near == j].sum(axis=0)
            if (norm := np.sqrt(s @ s)) > 0:
                c[j] = s / norm
    free = np.ones(len(c), bool)
    for j in range(len(c)):
        if free[j]:
            free[j + 1 :] &= c[j + 1 :] @ c[j] <= apart
    return c[free]


def build(x: np.ndarray, seed: int = 0) -> list[np.ndarray]:
    """Adjacency of a shard (unit rows): robust-pruned nearest and some random nodes, with reverse edges."""
    n = len(x)
    if n < 2:
        return [np.zeros(0, np.int64)] * n
    pool = min(POOL, n - 1)
    sim = x @ x.T
    np.fill_diagonal(sim, -2)
    near = np.argpartition(-sim, pool - 1, axis=1)[:, :pool]
    rng = np.random.default_rng(seed)
    far = rng.integers(0, n, (n, 8))
    far[far == np.arange(n)[:, None]] = near[:, 0].repeat(8)[(far == np.arange(n)[:, None]).ravel()]
    cand = np.concatenate([near, far], axis=1)
    s = np.take_along_axis(sim, cand, axis=1)
    order = np.argsort(-s, axis=1, kind="stable")
    cand, s = np.take_along_axis(cand, order, axis=1), np.take_along_axis(s, order, axis=1)
    alive = np.ones(cand.shape, bool)
    alive[:, 1:] &= cand[:, 1:] != cand[:, :-1]
    dist = np.sqrt(np.maximum(0, 2 - 2 * s))
    edges: list[list[int]] = [[] for _ in range(n)]
    for _ in range(DEGREE):
        on = np.flatnonzero(alive.any(axis=1))
        if not len(on):
            break
        first = alive[on].argmax(axis=1)
        pick = cand[on, first]
        for i, p in zip(on.tolist(), pick.tolist(), strict=True):
            edges[i].append(p)
        between = np.sqrt(np.maximum(0, 2 - 2 * np.clip(sim[pick[:, None], cand[on]], -1, 1)))
        between[cand[on] == pick[:, None]] = 0
        alive[on] &= ALPHA * between > dist[on]
        alive[on, first] = False
    out: list[set[int]] = [set(e) for e in edges]
    for i, e in enumerate(edges):
        for p in e:
            if len(out[p]) < 2 * DEGREE:
                out[p].add(i)
    return [np.array(sorted(e), np.int64) for e in out]


def search(x: np.ndarray, lists: list[np.ndarray], q: np.ndarray, least: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) reached with a product of ``least`` or more, by greedy search from the medoid over unit rows."""
    n, m = len(x), len(q)
    width = max((len(e) for e in lists), default=0)
    adj = np.full((n + 1, max(1, width)), n)
    for i, e in enumerate(lists):
        adj[i, : len(e)] = e
    padded = np.vstack([x, np.zeros(x.shape[1])])
    start = int((x @ x.sum(axis=0)).argmax())
    sim = np.full((m, n + 1), -np.inf)  # of what a query has met
    shut = np.full((m, n + 1), -np.inf)  # the same, -inf once expanded
    sim[:, start] = shut[:, start] = q @ x[start]
    active, beam, wide = np.arange(m), min(beam, n), min(EXPANDED, n)
    while len(active):
        open_ = shut[active]
        best = np.argpartition(open_, n + 1 - wide, axis=1)[:, n + 1 - wide :]
        value = np.take_along_axis(open_, best, axis=1)
        top = value.max(axis=1)
        go = top >= least
        doubt = np.flatnonzero(~go & (top > -np.inf))
        if len(doubt):  # outside the range only the best one, as long as it is among the beam's
            edge = np.partition(sim[active[doubt]], n + 1 - beam, axis=1)[:, n + 1 - beam]
            go[doubt] = top[doubt] >= edge
        chosen = np.where((top >= least)[:, None], value >= least, value == top[:, None])[go]
        active, best = active[go], np.where(chosen, best[go], n)
        if not len(active):
            break
        shut[active[:, None], best] = -np.inf
        to = adj[best].reshape(len(active), -1)
        new = (to < n) & (sim[active[:, None], to] == -np.inf)
        who, what = np.broadcast_to(active[:, None], to.shape)[new], to[new]
        flat = np.unique(who * (n + 1) + what)
        who, what = flat // (n + 1), flat % (n + 1)
        sim[who, what] = shut[who, what] = np.einsum("ij,ij->i", q[who], padded[what])
    return np.nonzero(sim[:, :n] >= least)


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node connected with it) for the ends of edges, where they differ."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while True:
        was = low.copy()
        least = np.minimum(low[x], low[y])
        np.minimum.at(low, x, least)
        np.minimum.at(low, y, least)
        low = low[low]
        if (low == was).all():
            return nodes[low < np.arange(len(nodes))], nodes[low[low < np.arange(len(nodes))]]


KEY = ["label", "dim", "cell"]
DEALT = "id long, label long, x array<double>, dim int, size long, cell long, first boolean"


def _cells(t: pa.Table | pa.RecordBatch, at: np.ndarray, cell: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    out = t.take(pa.array(at, pa.int64()))
    return pa.RecordBatch.from_arrays([*((c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c) for c in (out.column(k) for k in ("id", "label", "x", "dim", "size"))), pa.array(cell, pa.int64()), pa.array(first, pa.bool_())], names=["id", "label", "x", "dim", "size", "cell", "first"])


def clusters(nodes: DataFrame, least: float, overlap: int) -> DataFrame:
    """``nodes`` (id, label, x, dim, size) dealt to cells of their label and length: DEALT, with block and blocks.

    A node is in up to ``overlap`` cells, in one of them as ``first``.
    """
    spark = nodes.sparkSession
    apart = 2 * least * least - 1  # twice the angle of a link
    counts = materialize(nodes.groupBy("label", "dim").agg(F.count("*").alias("n")), "label-sizes")
    large = counts.where(F.col("n") > CELL)
    total = large.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    table: dict[tuple, np.ndarray] = {}
    if total:
        some = nodes.where(uniform("id", seed=3) < SAMPLE / total).join(large, ["label", "dim"])
        sample = some.select("id", "label", "dim", "x", "n").toArrow().sort_by("id")
        keys = list(zip(sample.column("label").to_pylist(), sample.column("dim").to_pylist(), strict=True))
        vectors, n = sample.column("x").to_pylist(), sample.column("n").to_pylist()
        where: dict[tuple, list[int]] = {}
        for i, key in enumerate(keys):
            where.setdefault(key, []).append(i)
        for key, at in where.items():
            own = _unit(np.array([vectors[i] for i in np.random.default_rng(1).permutation(at)], np.float64))
            table[key] = centres(own, max(1, min(-(-n[at[0]] // CELL), len(at) // 8)), apart)
    sent = spark.sparkContext.broadcast(table)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(b.column("label").to_pylist(), b.column("dim").to_pylist(), strict=True)):
                by.setdefault(key, []).append(i)
            for key, at in by.items():
                c = sent.value.get(key)
                near = np.zeros((len(at), 1), np.int64)
                if c is not None:
                    near = np.argsort(-(_unit(_matrix(b.column("x").take(pa.array(at)))) @ c.T), axis=1, kind="stable")[:, :overlap]
                yield _cells(b, np.repeat(at, near.shape[1]), near.ravel(), np.tile(np.arange(near.shape[1]) == 0, len(at)))

    def fit(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("id").to_numpy())
        c = centres(_unit(_matrix(t.column("x")))[np.random.default_rng(1).permutation(order)], max(2, min(SPLIT, -(-t.column("n")[0].as_py() // CELL), t.num_rows // 8)), apart)
        key = t.select(KEY).slice(0, 1).take(pa.array([0] * len(c)))
        return pa.table([*(key.column(k).cast(pa.int64()) for k in KEY), pa.array(c.tolist(), pa.list_(pa.float64()))], names=["l", "d", "c", "centre"])

    def split(rows: pa.Table, own: pa.Table) -> pa.Table:
        if not rows.num_rows or not own.num_rows:
            return rows.select(["id", "label", "x", "dim", "size", "cell", "first"])
        c = _matrix(own.column("centre"))
        c = c[np.lexsort(c.T)]
        near = np.argsort(-(_unit(_matrix(rows.column("x"))) @ c.T), axis=1, kind="stable")
        first = rows.column("first").to_numpy()
        count = np.where(first, min(overlap, len(c)), 1)
        at = np.repeat(np.arange(rows.num_rows), count)
        place = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        cell = rows.column("cell").to_numpy()[at] * (SPLIT + 1) + 1 + near[at, place]
        return pa.Table.from_batches([_cells(rows, at, cell, first[at] & (place == 0))])

    dealt = materialize(nodes.select("id", "label", "x", "dim", "size").mapInArrow(deal, DEALT), "dealt")
    done: list[DataFrame] = []
    for turn in range(ROUNDS):
        sizes = materialize(dealt.groupBy(*KEY).agg(F.count("*").alias("n")), "cell-sizes")
        over = sizes.where(F.col("n") > BLOCK)
        some = dealt.join(over, KEY).where(uniform("id", seed=11 + turn) < F.lit(CELL_SAMPLE) / F.col("n"))
        fitted = materialize(some.groupBy(*KEY).applyInArrow(fit, "l long, d long, c long, centre array<double>"), "centres")
        many = fitted.groupBy("l", "d", "c").count().where("count > 1")
        over = materialize(over.join(many, (over.label == many.l) & (over.dim == many.d) & (over.cell == many.c)).select(*KEY, "n"), "to-split")
        if over.isEmpty():
            break
        full = dealt.join(over, KEY)
        done.append(dealt.join(over, KEY, "left_anti"))
        chunks = F.ceil(F.col("n") / CHUNK).cast("int")
        spread = over.select(F.col("label").alias("l"), F.col("dim").cast("long").alias("d"), F.col("cell").alias("c"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("k"))
        rows = full.withColumn("chunk", F.pmod(F.xxhash64("id"), chunks).cast("int")).withColumn("dim_", F.col("dim").cast("long"))
        asked = rows.groupBy("label", "dim_", "cell", "chunk").cogroup(fitted.join(spread, ["l", "d", "c"]).groupBy("l", "d", "c", "k"))
        # copies of a node from several cells may meet in one
        copies = asked.applyInArrow(split, DEALT).groupBy("id", *KEY).agg(F.any_value("x").alias("x"), F.max("size").alias("size"), F.max("first").alias("first"))
        dealt = materialize(copies.select("id", "label", "x", "dim", "size", "cell", "first"), "dealt")
    for part in done:
        dealt = dealt.unionByName(part)
    # written, so that the join has no use for an exchange by cells, which would gather a large one in a task
    blocks = materialize(dealt.groupBy(*KEY).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks")
    return materialize(dealt.join(blocks, KEY).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), "shards")


def near_links(nodes: DataFrame, least: float, overlap: int = OVERLAP, beam: int = BEAM) -> DataFrame:
    """id, linked, to: for a node (id, label, x, dim, size) that has links the size of its linked nodes, as far as one
    shard knows (``to`` null), and edges (``linked`` null) that connect the same nodes as the links."""
    dealt = clusters(nodes, least, overlap)

    def shard(t: pa.Table) -> pa.Table:
        ids, x = t.column("id").to_numpy(), _unit(_matrix(t.column("x")))
        order = np.argsort(ids)
        lists = build(x[order])
        src = np.repeat(ids[order], [len(e) for e in lists])
        dst = ids[order][np.concatenate(lists).astype(np.int64)] if len(lists) else ids[:0]
        return pa.table({"id": pa.array(src), "to": pa.array(dst)})

    edges = dealt.groupBy(*KEY, "block").applyInArrow(shard, "id long, to long")
    united = materialize(edges.groupBy("id").agg(F.collect_set("to").alias("to")), "graph")
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias(c)
    held = dealt.join(united, "id", "left").select(*KEY, "block", spread("asking"), "id", "size", "x", "to")
    asked = dealt.where("first").select(F.col("label").alias("l"), F.col("dim").alias("d"), F.col("cell").alias("c"), spread("b"), F.col("block").alias("k"), F.col("id").alias("qid"), F.col("x").alias("qx"))

    def look(nodes: pa.Table, queries: pa.Table) -> pa.Table:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        counted: list[tuple[np.ndarray, np.ndarray]] = [(a[0], b[0])]
        if nodes.num_rows and queries.num_rows:
            ids, x, size = nodes.column("id").to_numpy(), _matrix(nodes.column("x")), nodes.column("size").to_numpy()
            order = np.argsort(ids)
            ids, unit, size = ids[order], _unit(x[order]), size[order]
            to = nodes.column("to").to_pylist()
            lists = []
            for i in order:
                e = np.array(to[i] or [], np.int64)
                at = np.minimum(np.searchsorted(ids, e), len(ids) - 1)
                lists.append(at[ids[at] == e])
            qids, q = queries.column("qid").to_numpy(), _unit(_matrix(queries.column("qx")))
            for s in range(0, len(q), 500):
                who, what = search(unit, lists, q[s : s + 500], least - 1e-9, beam)
                own = qids[s : s + 500]
                good = (np.einsum("ij,ij->i", q[s : s + 500][who], unit[what]) >= least) & (own[who] != ids[what])
                who, what = who[good], what[good]
                total = np.bincount(who, weights=size[what], minlength=len(own)).astype(np.int64)
                counted.append((own[total > 0], total[total > 0]))
                x, y = roots(own[who], ids[what])
                a.append(x)
                b.append(y)
        x, y = roots(np.concatenate(a), np.concatenate(b))
        q, n = (np.concatenate(c) for c in zip(*counted, strict=True))
        none = lambda k: pa.nulls(k, pa.int64())
        return pa.table({"id": pa.array(np.concatenate([q, x])), "linked": pa.chunked_array([pa.array(n), none(len(x))]).combine_chunks(), "to": pa.chunked_array([none(len(q)), pa.array(y)]).combine_chunks()})

    key = [*KEY, "block", "asking"]
    return held.groupBy(*key).cogroup(asked.groupBy("l", "d", "c", "b", "k")).applyInArrow(look, "id long, linked long, to long")


def true_links(nodes: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """id, true: for nodes holding an id divisible by 20 the size of all their linked nodes, by brute force: that query
    set against all rows of the label, in blocks."""
    # queries are a twentieth of the rows, and so are their parts of the blocks
    n = nodes.groupBy("label", "dim").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("blocks"), F.ceil(F.count("*") / CHUNK / 20).cast("int").alias("parts"))
    rows = nodes.join(n, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    wanted = members.where("vec % 20 = 0").select("id").distinct()
    asked = rows.join(wanted, "id", "left_semi").withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int"))
    spread = lambda c, of: F.explode(F.sequence(F.lit(0), F.col(of) - 1)).alias(c)
    asked = asked.select(F.col("label").alias("l"), F.col("dim").alias("d"), spread("b", "blocks"), "part", F.col("id").alias("qid"), F.col("x").alias("qx"))
    rows = rows.select("label", "dim", "block", spread("part", "parts"), "id", "size", "x")

    def count(refs: pa.Table, queries: pa.Table) -> pa.Table:
        if not refs.num_rows or not queries.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        x, q, ids, size = _unit(_matrix(refs.column("x"))), _unit(_matrix(queries.column("qx"))), refs.column("id").to_numpy(), refs.column("size").to_numpy()
        qids, out = queries.column("qid").to_numpy(), []
        for s in range(0, len(q), 500):
            hit = (q[s : s + 500] @ x.T >= least) & (qids[s : s + 500, None] != ids)
            out.append(hit @ size)
        return pa.table({"id": pa.array(qids), "n": pa.array(np.concatenate(out).astype(np.int64))})

    pairs = rows.groupBy("label", "dim", "block", "part").cogroup(asked.groupBy("l", "d", "b", "part")).applyInArrow(count, "id long, n long")
    return pairs.groupBy("id").agg(F.sum("n").alias("true"))


def dedup_vectors(vectors: DataFrame, least: float = 0.98, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept and the audit's recall, one row for each row of ``vectors``.

    Linked are vectors of one label, not null, and one length, whose cosine is ``least`` or more. Vectors null, empty,
    zero, or with null or non-finite components, and rows with a null id, link with nothing and are kept. Equal
    vectors link with each other. Rows that share an id count as one vector (the least, if they differ). Among equal vectors and in components the
    smallest id is kept.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    usable = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("x") > 0) & ~bad & F.exists("x", lambda c: c != 0), F.lit(False))
    ok = v.where(usable).select("id", "label", F.transform("x", lambda c: c + 0.0).alias("x"))
    # nodes: a label's distinct vectors, known by their smallest id
    first = materialize(ok.groupBy("label", "x").agg(F.min("id").alias("id")), "first-ids")
    member = materialize(ok.select("label", "x", F.col("id").alias("vec")).join(first, ["label", "x"]).select("id", "vec").distinct(), "members")
    sizes = member.groupBy("id").agg(F.count("*").alias("size"))
    nodes = first.groupBy("id").agg(F.min(F.struct("label", "x")).alias("v")).join(sizes, "id")
    nodes = materialize(nodes.select("id", "v.label", "v.x", F.size("v.x").alias("dim"), "size"), "nodes")
    true = materialize(true_links(nodes, member, least), "audit")
    for wider in (1, 2, 4):
        links = materialize(near_links(nodes, least, wider * OVERLAP, wider * BEAM), "vector-links")
        linked = materialize(links.where("linked is not null").groupBy("id").agg(F.sum("linked").alias("linked")), "linked")
        found, all_ = true.join(linked, "id", "left").agg(F.coalesce(F.sum("linked"), F.lit(0)), F.coalesce(F.sum("true"), F.lit(0))).first()
        recall = found / all_ if all_ else 1.0
        if recall >= LEAST_RECALL:
            break
    else:
        warnings.warn(f"recall of vector links is {recall:.3f}", stacklevel=2)
    joined = components(links.where("to is not null").select(F.col("id").alias("a"), F.col("to").alias("b"))).select(F.col("node").alias("id"), "component")
    per = sizes.join(linked, "id", "left").join(joined, "id", "left")
    per = per.select("id", (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component"))
    per = member.join(per, "id").groupBy("vec").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component"))
    out = v.select("id").join(per, F.col("id") == F.col("vec"), "left").withColumn("recall", F.lit(float(recall)))
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), "recall")
