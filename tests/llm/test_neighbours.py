from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import neighbours
from strandline.llm.neighbours import CrossPolytope, _hadamard, block_nearest, nearest_neighbours

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string, rank string, bucket string"


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x", "x", "x") for i, v in vectors], SCHEMA)


def brute(vectors, query, k=10):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in vectors if i is not None and v is not None and len(v) and all(x is not None for x in v) and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, x in good:
        if q != query:
            continue
        for i, y in good:
            if i != q and len(x) == len(y):
                d = float(np.sqrt(((x - y) ** 2).sum()))
                out[i] = min(out.get(i, d), d)
    return sorted(out.items(), key=lambda t: (t[1], t[0]))[:k]


def test_rotations_keep_lengths_and_spread_axes():
    x = np.eye(16)
    assert np.allclose(np.linalg.norm(_hadamard(x), axis=1), 1) and np.allclose(_hadamard(_hadamard(x)), x)
    h = CrossPolytope(12)
    v = np.random.default_rng(1).normal(size=(2000, 12))
    assert np.allclose(np.linalg.norm(h.rotated(v, 3), axis=1), 1)
    assert (np.bincount(h.buckets(v, 0), minlength=32) > 3).all()
    assert not (h.buckets(v, 0) == h.buckets(v, 1)).all()


def test_blocks_are_exact_with_ties():
    r = np.random.default_rng(2)
    x = r.integers(-2, 3, (300, 4)).astype(float)
    ids = r.permutation(300)
    got = block_nearest(ids[:20], x[:20], ids, x, 10)
    want = [(int(q), i, d) for q, v in zip(ids[:20], x[:20], strict=True) for d, i in sorted((float(np.sqrt(((v - y) ** 2).sum())), int(i)) for i, y in zip(ids, x, strict=True) if i != q)[:10]]
    assert got == want


def test_small_tables_are_searched_whole(spark):
    r = np.random.default_rng(3)
    vectors = [(i, r.normal(size=8).tolist()) for i in range(0, 205, 5)]
    vectors += [(1, None), (2, []), (3, [0.0] * 8), (4, [None] + [1.0] * 7), (6, [float("nan")] + [1.0] * 7), (7, [float("inf")] * 8), (None, [1.0] * 8), (8, [1.0, 2.0]), (100, r.normal(size=8).tolist()), (9, vectors[0][1]), (11, vectors[0][1])]
    rows = nearest_neighbours(table(spark, vectors), F.col("vec_id") % 100 == 0).collect()
    got = {}
    for x in sorted(rows, key=lambda x: (x["query_id"], x["rank"])):
        got.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
    assert set(got) == {0, 100, 200}
    for q, found in got.items():
        want = brute(vectors, q)
        assert [i for i, _ in found] == [i for i, _ in want] and np.allclose([d for _, d in found], [d for _, d in want], atol=1e-12)
    assert got[0][0] == (9, 0.0) and got[0][1] == (11, 0.0)


def test_fewer_candidates_and_none(spark):
    few = nearest_neighbours(table(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (5, [1.0, 1.0])]), F.col("vec_id") % 100 == 0)
    assert [(r["rank"], r["vec_id"]) for r in few.orderBy("rank").collect()] == [(1, 5), (2, 1)]
    assert nearest_neighbours(table(spark, [(0, [1.0])]), F.col("vec_id") % 100 == 0).count() == 0
    assert nearest_neighbours(table(spark, []), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("block", [4096, 64])
def test_recall(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK_VECTORS", block)
    r = np.random.default_rng(4)
    x = r.normal(size=(6000, 32)).astype(np.float32)
    x[1000:1800] = x[0]  # one vector very many times
    vectors = [(i, v.tolist()) for i, v in enumerate(x)]
    rows = nearest_neighbours(table(spark, vectors), F.col("vec_id") % 100 == 0, least=100).collect()
    found = {}
    for row in rows:
        found.setdefault(row["query_id"], set()).add(row["vec_id"])
    hits = [len(found[q] & {i for i, _ in brute_fast(x, q)}) for q in range(0, 6000, 100)]
    assert sum(hits) / (10 * len(hits)) >= 0.9 and all(len(v) == 10 for v in found.values())
    assert found[0] == set(range(1000, 1010)) and found[1000] == {0, *range(1001, 1010)}


def brute_fast(x, q, k=10):
    d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
    d[q] = np.inf
    order = np.lexsort((np.arange(len(x)), d))[:k]
    return [(int(i), d[i]) for i in order]


def test_very_large_and_very_small_numbers(spark):
    r = np.random.default_rng(7)
    for scale in (1e160, 1e-170, 1e300):
        x = r.normal(size=(60, 6)) * scale
        vectors = [(i, v.tolist()) for i, v in enumerate(x)]
        df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")
        got = [(a["vec_id"], a["score"]) for a in nearest_neighbours(df, F.col("vec_id") == 0).orderBy("rank").collect()]
        unit = x / scale
        want = sorted((float(np.sqrt(((unit[0] - y) ** 2).sum())), i) for i, y in enumerate(unit) if i)[:10]
        assert [i for i, _ in got] == [i for _, i in want] and np.allclose([d / scale for _, d in got], [d for d, _ in want], rtol=1e-12)
    mixed = [(0, [1.0, 1e160]), (1, [1.0, 2e160]), (2, [5.0, 1e160]), (3, [1.0, 1.0]), (4, [2.0, 1.0])]
    df = spark.createDataFrame(mixed, "vec_id bigint, embedding array<double>")
    assert [a["vec_id"] for a in nearest_neighbours(df, F.col("vec_id") == 3).orderBy("rank").collect()][0] == 4
    assert [a["vec_id"] for a in nearest_neighbours(df, F.col("vec_id") == 0).orderBy("rank").collect()][:1] == [2]


def test_more_axes_as_tables_grow(spark, monkeypatch):
    assert [neighbours.axes_for(n, 64) for n in (10, 128 * 4096, 128 * 4096 + 1, 128**2 * 4096 + 1, 10**15)] == [1, 1, 2, 3, neighbours.MOST_AXES]
    r = np.random.default_rng(8)
    # 600 groups of 20: neighbours are near, as those of embeddings are
    centres = r.normal(size=(600, 16))
    x = (np.repeat(centres, 20, axis=0) + 0.05 * r.normal(size=(12_000, 16))).astype(np.float32)
    vectors = [(i, v.tolist()) for i, v in enumerate(x)]
    monkeypatch.setattr(neighbours, "BUCKET_VECTORS", 4)
    monkeypatch.setattr(neighbours, "BLOCK_VECTORS", 16)
    assert neighbours.axes_for(len(x), 16) == 3
    rows = nearest_neighbours(table(spark, vectors), F.col("vec_id") % 100 == 0).collect()
    found = {}
    for row in rows:
        found.setdefault(row["query_id"], set()).add(row["vec_id"])
    hits = [len(found.get(q, set()) & {i for i, _ in brute_fast(x, q)}) for q in range(0, 12_000, 100)]
    assert sum(hits) / (10 * len(hits)) >= 0.9


def test_a_hash_of_several_axes_probes_its_own_bucket_first():
    r = np.random.default_rng(9)
    h = CrossPolytope(12, axes=3)
    v = r.normal(size=(50, 12))
    for t in range(3):
        near = h.near_buckets(v, t, 8)
        assert near.shape == (50, 8) and (near[:, 0] == h.buckets(v, t)).all() and all(len(set(x)) == 8 for x in near.tolist())
        sums = h.scores(v, t, 0)[:, :, None, None] + h.scores(v, t, 1)[:, None, :, None] + h.scores(v, t, 2)[:, None, None, :]
        every = sums.reshape(50, -1)
        best = -np.sort(-every, axis=1)[:, :8]  # sums may tie
        assert np.allclose(-np.sort(-np.take_along_axis(every, near, 1), axis=1), best, rtol=0, atol=1e-12)


def test_queries_and_vectors_are_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_VECTORS", 20)
    r = np.random.default_rng(10)
    vectors = [(i, r.normal(size=5).tolist()) for i in range(150)] + [(1000 + i, r.normal(size=3).tolist()) for i in range(30)]
    rows = nearest_neighbours(table(spark, vectors), F.col("vec_id") % 3 == 0).collect()
    got = {}
    for x in sorted(rows, key=lambda x: (x["query_id"], x["rank"])):
        got.setdefault(x["query_id"], []).append(x["vec_id"])
    assert got == {q: [i for i, _ in brute(vectors, q)] for q, _ in vectors if q % 3 == 0}
