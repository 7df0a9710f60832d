import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import vector_dedup


def brute(rows, least):
    """{row number: (n_links, component, kept)} by comparing every pair."""
    ok = [i is not None and lab is not None and v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) for i, lab, v in rows]
    ids = {i for (i, _, _), o in zip(rows, ok, strict=True) if o}
    by = {i: next((lab, np.array(v, float)) for (k, lab, v), o in zip(rows, ok, strict=True) if o and k == i) for i in ids}
    links, parent = {i: 0 for i in ids}, {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(ids)
    for n, a in enumerate(order):
        for b in order[:n]:
            (la, x), (lb, y) = by[a], by[b]
            if la == lb and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return sorted(((i, links[i], find(i), find(i) == i) if o else (i, 0, i, True) for (i, _, _), o in zip(rows, ok, strict=True)), key=repr)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    rows, k = [], 0
    for label in (0, 1, 2):
        for _ in range(60):
            base = rng.normal(size=8)
            for _ in range(rng.integers(1, 6)):
                rows.append((k, label, (base + rng.normal(size=8) * rng.choice([0.0, 0.02, 0.1])).tolist()))
                k += 1
    rows += [(k + j, 1, v) for j, v in enumerate([None, [], [0.0] * 8, [None] + [1.0] * 7, [math.nan] * 8, [math.inf] + [1.0] * 7, [1e-30] * 8, [2e-30] * 8, [1.0, 2.0], [1.0, 2.0], [-0.0, 1.0], [0.0, 1.0]])]
    rows += [(k + 20, None, rows[0][2]), (None, 0, rows[0][2]), rows[3], rows[3]]
    return rows


@pytest.mark.parametrize("cell", [12, 300])
def test_vectors(spark, vectors, monkeypatch, cell):
    """With tiny cells they are split in rounds and cut into blocks; links of the blocks add up."""
    monkeypatch.setattr(vector_dedup, "CELL", cell)
    monkeypatch.setattr(vector_dedup, "BLOCK", 10 if cell == 12 else 1000)
    monkeypatch.setattr(vector_dedup, "SAMPLE", 100 if cell == 12 else 20_000)
    monkeypatch.setattr(vector_dedup, "CHUNK", 40 if cell == 12 else 4000)
    df = spark.createDataFrame([(i, lab, v, 1, "x") for i, lab, v in vectors], "vec_id long, label int, embedding array<double>, id int, x string").repartition(3)
    rows = vector_dedup.dedup_vectors(df).collect()
    got = sorted((tuple(r)[:4] for r in rows), key=repr)
    want = brute(vectors, 0.98)
    assert [r[0] for r in got] == [r[0] for r in want]
    true, found = sum(r[1] for r in want), sum(r[1] for r in got)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True)) and found >= 0.95 * true
    asked = [(g, w) for g, w in zip(got, want, strict=True) if g[0] is not None and g[0] % 20 == 0]
    assert rows[0].recall >= 0.9 and (rows[0].recall == 1) >= all(g[1] == w[1] for g, w in asked)
    if cell == 300:
        assert got == want and rows[0].recall == 1


def test_near_copies_in_one_mass(spark, monkeypatch):
    """No centres split them; blocks count every link and give edges by the number of nodes."""
    monkeypatch.setattr(vector_dedup, "CELL", 20)
    monkeypatch.setattr(vector_dedup, "BLOCK", 40)
    rng = np.random.default_rng(5)
    base = rng.normal(size=8)
    rows = [(k, 1, (base + 0.001 * rng.normal(size=8)).tolist()) for k in range(200)] + [(k, 1, rng.normal(size=8).tolist()) for k in range(200, 260)] + [(k, 2, base.tolist()) for k in range(260, 300)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = vector_dedup.dedup_vectors(df)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=repr) == brute(rows, 0.98)
    nodes = df.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("x"), F.size("embedding").alias("dim"), F.lit(1).cast("long").alias("size")).where("id < 260")
    assert vector_dedup.near_links(nodes, 0.98).count() < 6000  # of 39,800 links


def test_wider_search_when_the_audit_falls_short(spark, vectors, monkeypatch):
    seen = []
    real = vector_dedup.near_links

    def poor(nodes, least, overlap, beam):
        seen.append(overlap)
        return real(nodes, least, overlap, beam) if len(seen) > 1 else nodes.sparkSession.createDataFrame([], "id long, linked long, to long")

    monkeypatch.setattr(vector_dedup, "near_links", poor)
    df = spark.createDataFrame(vectors, "vec_id long, label int, embedding array<double>")
    got = vector_dedup.dedup_vectors(df)
    assert seen == [vector_dedup.OVERLAP, 2 * vector_dedup.OVERLAP]
    assert sorted((tuple(r)[:4] for r in got.collect()), key=repr) == brute(vectors, 0.98)


def test_roots():
    a, b = np.array([5, 9, 3, 7, 8, 8]), np.array([9, 3, 4, 6, 8, 7])
    assert dict(zip(*map(np.ndarray.tolist, vector_dedup.roots(a, b)), strict=True)) == {4: 3, 5: 3, 9: 3, 7: 6, 8: 6}
    assert len(vector_dedup.roots(a[:0], b[:0])[0]) == 0


def test_empty(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert vector_dedup.dedup_vectors(empty).count() == 0


def test_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.label, r.embedding) for r in df.collect()][:300]
    got = vector_dedup.dedup_vectors(df.where(F.col("vec_id").isin([r[0] for r in rows])), least=0.6)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=repr) == brute(rows, 0.6)
