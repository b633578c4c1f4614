"""Hard negatives against brute force over all pairs, and the vantage-point tree by itself."""

import math
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgraph.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, id string, part long, vec string, low long"


def vectors(n=500, width=10, seed=5):
    r = random.Random(seed)
    centres = [[r.gauss(0, 0.3) for _ in range(width)] for _ in range(12)]
    out = []
    for i in range(n):
        c = r.randrange(12)
        out.append((i * 5, [x + r.gauss(0, 0.2) for x in centres[c]], None if i % 41 == 0 else c % 4))
    out += [(5000 + i, list(out[11][1]), i % 3) for i in range(40)]  # equal vectors
    odd = [None, [], [0.0] * width, [0.5] * (width - 3), [1.0, None] + [0.5] * (width - 2), [float("nan")] * width, [float("inf")] + [1.0] * (width - 1), [1e30] * width]
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c) for i, v, c in out + [(10_000 + i * 50, v, 1) for i, v in enumerate(odd)] + [(None, [1.0] * width, 1)]]


def brute(rows):
    good = [(i, c, [math.floor(256 * x) for x in v]) for i, v, c in rows if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) and abs(x) < 1e9 for x in v)]
    out = []
    for q, label, x in good:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), i, c) for i, c, y in good if i != q)
            for s, p, _ in [t for t in scored if t[2] == label][:5]:
                found = [(n, t) for n, t, c in scored if c != label and 50 * -s <= 100 * -n <= 95 * -s][:3]
                out += [(q, p, rank, t, -s, -n) for rank, (n, t) in enumerate(found, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, c, "x", 1, "t", 2) for i, v, c in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("group,slice_", [(H.GROUP, H.SLICE), (60, 9)])
def test_negatives_equal_brute_force(spark, monkeypatch, group, slice_):
    monkeypatch.setattr(H, "GROUP", group)
    monkeypatch.setattr(H, "SLICE", slice_)
    rows = vectors()
    got = H.mine(frame(spark, rows), F.col("vec_id") % 50 == 0, F.col("label"))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows)
    assert len(want) > 300 and sorted(tuple(r) for r in got.collect()) == want


def test_few_or_no_rows(spark):
    rows = vectors()
    for part in ([], rows[:1], rows[1:3], [(0, [1.0], 1), (1, [1.0], 1), (2, [0.75], 2)]):
        got = H.mine(frame(spark, part), F.col("vec_id") % 50 == 0, F.col("label")).collect()
        assert sorted(tuple(r) for r in got) == brute(part)


@pytest.mark.parametrize("leaf", [4, 64])
@pytest.mark.parametrize("size", [1, 300, 3_000_000])
def test_the_tree_finds_the_best_of_each_window(leaf, size):
    r = np.random.default_rng(leaf + size)
    x = np.floor(r.normal(size=(900, 6)) * 9 * size).astype(np.int64)
    x[100:200] = x[100]
    ids, labels = r.permutation(900), r.integers(3, size=900)
    tree = H.VantageTree(x, ids, labels, leaf)
    q = x[r.integers(900, size=40)]
    q_ids, q_labels = r.integers(900, size=40), r.integers(3, size=40)
    of = np.repeat(np.arange(40), 3)
    scores = (q.astype(object) @ x.T.astype(object)).astype(np.int64)
    a, b = np.sort(np.stack([np.take_along_axis(scores[of], r.integers(900, size=(120, 1)), 1)[:, 0] for _ in range(2)]), 0)
    for low, high in ((a, b), (np.full(120, H.NONE + 1), np.full(120, H.MOST))):
        for same in (True, False):
            got, found = tree.search(q, q_ids, q_labels, of, low, high, 7, same)
            for w in range(120):
                o = of[w]
                fit = sorted((-int(s), int(i)) for s, i, c in zip(scores[o], ids, labels) if (c == q_labels[o]) == same and i != q_ids[o] and low[w] <= s <= high[w])[:7]
                assert [(-int(s), int(i)) for s, i in zip(got[w], found[w]) if s > H.NONE] == fit


def test_leaves_outside_the_annulus_stay_closed():
    r = np.random.default_rng(3)
    x = r.normal(size=(40, 4))[r.integers(40, size=4000)] + r.normal(size=(4000, 4)) * 0.05
    x = np.floor(x / np.linalg.norm(x, axis=1)[:, None] * 256).astype(np.int64)
    tree = H.VantageTree(x, np.arange(4000), np.zeros(4000, np.int64), 64)
    opened = []
    tree.search(x[::50], np.arange(0, 4000, 50), np.zeros(80, np.int64), np.arange(80), np.full(80, H.NONE + 1), np.full(80, H.MOST), 5, True, opened)
    assert opened[0] < 0.35 * opened[1]
    opened, best = [], np.full(80, 256 * 256)
    tree.search(x[::50], np.arange(0, 4000, 50), np.ones(80, np.int64), np.arange(80), best * 6 // 10, best * 7 // 10, 3, False, opened)
    assert opened[0] < 0.45 * opened[1]


def test_the_query_equals_its_sql(spark):
    con = duckdb.connect()
    path = Path("/root/testdata/sf0.01")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet'")
    want = con.execute(H.SQL)
    columns = [d[0] for d in want.description]
    got = H.op13_hard_negatives(spark, str(path)).select(*columns).collect()
    assert sorted(tuple(r) for r in got) == sorted(want.fetchall()) and got
