"""Top-k search and near vectors against brute force over all pairs."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loamgraph.llm import near_vectors, topk

SCHEMA = "vec_id long, embedding array<float>, label int, id string, n long, tile string"


def vectors(n=260, width=12, seed=4):
    r = random.Random(seed)
    out = []
    for i in range(n):
        if i % 3 and i > 3:
            v = [x + r.gauss(0, 0.05) for x in out[r.randrange(len(out))][1]]
        else:
            v = [r.gauss(0, 1) for _ in range(width)]
        out.append((i * 5, v))
    out += [(2000 + i, list(out[7][1])) for i in range(5)]  # equal vectors
    odd = [None, [], [0.0] * width, [1.0, None] + [0.5] * (width - 2), [float("nan")] * width, [float("inf")] + [1.0] * (width - 1)]
    return out + [(3000 + i * 20, v) for i, v in enumerate(odd)]


def single(x):
    """The components as the table holds them."""
    import numpy as np

    return None if x is None else [None if c is None else float(np.float32(c)) for c in x]


@pytest.fixture(scope="module")
def rows():
    return [(i, single(v)) for i, v in vectors()]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1, "t") for i, v in rows], SCHEMA).repartition(3)


def finite(v):
    return bool(v) and all(c is not None and math.isfinite(c) for c in v)


@pytest.mark.parametrize("block", [topk.BLOCK, 16])
def test_topk_equals_brute_force(spark, rows, monkeypatch, block):
    monkeypatch.setattr(topk.search, "__defaults__", (block,))
    monkeypatch.setattr(topk, "RANGE", 100)
    good = [(i, [math.floor(64 * c) for c in v]) for i, v in rows if finite(v)]
    want = set()
    for q, x in good:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in good if i != q)
            want |= {(q, k, i, -s) for k, (s, i) in enumerate(scored[:20], 1)}
    got = topk.top_k(frame(spark, rows), F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_topk_of_huge_components(spark):
    data = [(0, [1e9, -3e9, 2.0]), (5, [-1e15, 1e15, 1.0]), (20, [-1e30, 0.0, 1.0]), (40, [1e17, 1e17, -1e17]), (60, [1e17, 1e17, 1e17]), (60, [0.5, 0.25, -0.01])]
    docs = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(2)
    good = [(i, [math.floor(64 * c) for c in v]) for i, v in data if i != 20]
    want = []
    for q, x in good:
        if q % 20 == 0:
            scored = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(x, y)))), i) for i, y in good if i != q)
            want += [(q, k, i, -s) for k, (s, i) in enumerate(scored, 1)]
    got = topk.top_k(docs, F.col("vec_id") % 20 == 0).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got if r.query_id != 60} == {w for w in want if w[0] != 60}


def test_blocks_of_far_clusters_are_not_scored():
    import numpy as np

    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 32)) * 300
    docs = np.floor(centres[r.integers(40, size=4000)] + r.normal(size=(4000, 32)) * 8).astype(np.int64)
    scored = []
    ids = np.arange(4000)
    best, _ = topk.search(docs[::50], ids[::50], docs, ids, 20, scored=scored)
    full = docs[::50] @ docs.T
    full[np.arange(80), ids[::50]] = -(1 << 62)
    assert (best == -np.sort(-full, 1)[:, :20]).all()
    assert scored[0] < 0.35 * scored[1]


def test_queries_times_ranges_are_neither_broadcast_nor_dealt(spark, rows, monkeypatch):
    monkeypatch.setattr(topk, "RANGE", 60)
    plan = topk.top_k(frame(spark, rows), F.col("vec_id") % 20 == 0)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan and "SortMergeJoin" not in plan


def test_the_best_are_kept_from_range_to_range():
    import numpy as np

    r = np.random.default_rng(5)
    docs, ids = r.integers(-200, 200, (900, 6)), r.integers(0, 700, 900)
    docs[300:600] <<= 20  # sums beyond the integers of a float, then of a double
    docs[600:] <<= 45
    best = topk.Best(docs[:50], ids[:50], 15)
    for a in range(0, 900, 300):
        best.visit(docs[a : a + 300], ids[a : a + 300], np.arange(0, 300, 40))
    full = best.queries.astype(object) @ docs.T.astype(object)
    want = [sorted((-full[n, j], ids[j]) for j in range(900) if ids[j] != ids[n])[:15] for n in range(50)]
    assert [[(-x, y) for x, y in zip(s, i)] for s, i in zip(best.scores.tolist(), best.ids.tolist())] == want


def test_near_vectors_of_tiny_and_huge_components(spark):
    data = [(0, [1e-200, 0.0]), (1, [2e-200, 1e-205]), (2, [1.0, 0.0]), (3, [0.0, 3e200]), (4, [1e180, 5e200]), (5, [-1.0, 0.0]), (6, [0.0, 0.0]), (7, [5e-324, 0.0]), (2, [1.0, 0.0])]
    got = near_vectors.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(0, 4, 0), (1, 4, 0), (2, 4, 0), (2, 4, 0), (3, 1, 3), (4, 1, 3), (5, 0, 5), (6, 0, 6), (7, 4, 0)]


def test_topk_few_or_no_candidates(spark, rows):
    assert topk.top_k(frame(spark, rows).limit(0), F.col("vec_id") % 20 == 0).collect() == []
    two = topk.top_k(frame(spark, rows[:2]), F.lit(True)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in two) == [(0, 1, 5), (5, 1, 0)]


@pytest.mark.parametrize("tile", [near_vectors.TILE, 40])
def test_near_vectors_equal_brute_force(spark, rows, monkeypatch, tile):
    monkeypatch.setattr(near_vectors, "TILE", tile)
    good = {i: v for i, v in rows if finite(v) and any(v)}
    norm = {i: math.sqrt(sum(c * c for c in v)) for i, v in good.items()}
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    ids = sorted(good)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sum(x * y for x, y in zip(good[a], good[b])) / (norm[a] * norm[b]) >= 0.95:
                links[a] += 1
                links[b] += 1
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    got = near_vectors.near_duplicates(frame(spark, rows)).collect()
    assert sum(links.values()) > 100
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == sorted((i, links[i], root(i), root(i) == i) for i, _ in rows)


def test_near_vectors_of_an_empty_table(spark, rows):
    assert near_vectors.near_duplicates(frame(spark, rows).limit(0)).collect() == []
