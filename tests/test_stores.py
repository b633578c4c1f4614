"""Stores in buckets, paths in the graph and salvage of broken JSON, on small cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loamgraph.functions import salvage as J
from loamgraph.operators import graph
from loamgraph.session import shared_path
from loamgraph.streaming.store import Archive, Store

SCHEMA = "document_id long, title string, doc_type string, content string"


def docs(spark, rows):
    return spark.createDataFrame([(i, f"t{i}", "x", c) for i, c in rows], SCHEMA)


def test_a_batch_rewrites_the_buckets_it_touches(spark):
    a = Archive(spark, shared_path(spark, "store"), 16)
    a.sync(0, docs(spark, [(i, f"text {i}") for i in range(200)] + [(None, "no id")]))
    assert a.documents.read().count() == 200 and set(a.documents.manifest().values()) == {0}
    assert a.sync(1, docs(spark, [(3, "new"), (4, "text 4"), (500, None)]), spark.createDataFrame([(7,), (999,)], "document_id long"))[1] <= 4
    held = a.documents.manifest()
    assert sum(n == 1 for n in held.values()) <= 4 and sum(n == 0 for n in held.values()) >= 12
    got = {r.document_id: (r.content, r.version) for r in a.documents.read().collect()}
    assert got[3] == ("new", 2) and got[4] == ("text 4", 1) and got[500] == ("", 1) and 7 not in got and len(got) == 200
    assert {r.document_id for r in a.chunks.read().collect()} == set(got)
    before = sorted(tuple(r) for r in a.documents.read().collect())
    a.sync(1, docs(spark, [(3, "new"), (4, "text 4"), (500, None)]), spark.createDataFrame([(7,), (999,)], "document_id long"))
    assert sorted(tuple(r) for r in a.documents.read().collect()) == before and a.documents.batches() == [0, 1]
    a.sync(2, docs(spark, [(4, "text 4")]))
    assert 2 not in a.documents.manifest().values() and sorted(tuple(r) for r in a.documents.read().collect()) == before
    a.documents.vacuum()
    assert sorted(tuple(r) for r in a.documents.read().collect()) == before and a.documents.batches() == [2]


def test_random_batches_equal_a_dictionary(spark):
    r = random.Random(2)
    s = Store(spark, shared_path(spark, "store"), "document_id long, value long", 4)
    want = {}
    for n in range(4):
        ids = {r.randrange(40) for _ in range(r.randrange(1, 12))}
        rows = [(i, k) for i in ids if r.random() < 0.7 for k in range(r.randrange(1, 3))]
        want = {i: v for i, v in want.items() if i not in ids} | {i: sorted(v for j, v in rows if j == i) for i, _ in rows}
        s.replace(n, spark.createDataFrame(rows, "document_id long, value long"), spark.createDataFrame([(i,) for i in ids], "document_id long"))
        got = {}
        for x in s.read().collect():
            got.setdefault(x.document_id, []).append(x.value)
        assert {i: sorted(v) for i, v in got.items()} == want


@pytest.mark.parametrize("limit", [1000, 3])
def test_paths_use_no_edge_twice(spark, limit):
    r = random.Random(limit)
    e = sorted({(f"n{r.randrange(7)}", r.choice("AB"), f"n{r.randrange(7)}") for _ in range(12)})
    want, level = set(), [("n0", ["n0"], []), ("n1", ["n1"], [])]
    for hops in (1, 2, 3):
        more = []
        for seed, nodes, steps in level:
            for a, t, b in e:
                step = f"{a}|{t}|{b}"
                for x, y in {(a, b), (b, a)}:
                    if x == nodes[-1] and step not in steps:
                        more.append((seed, [*nodes, y], [*steps, step]))
        level = [x for s in ("n0", "n1") for x in sorted((m for m in more if m[0] == s), key=lambda m: (m[2], m[1]))[:limit]]
        want |= {(s, hops, tuple(n), tuple(p)) for s, n, p in level}
    edge, seeds = spark.createDataFrame(e, "src string, rel_type string, dst string"), spark.createDataFrame([("n0",), ("n1",), ("n1",)], "id string")
    got = [(x.seed, x.hops, tuple(x.nodes), tuple(x.steps)) for x in graph.paths(edge, seeds, 3, limit).collect()]
    assert set(got) == want and len(got) == len(want)


GOLDEN = [
    ('{"a": 1}', {"a": 1}, "whole"),
    ("[1, 2]", {"items": [1, 2]}, "whole"),
    ("7", {}, "whole"),
    (None, {}, "empty"),
    ("  ", {}, "empty"),
    ('```json\n{"a": [1, 2,],}\n```', {"a": [1, 2]}, "mended"),
    ("{'a': 'b',}", {"a": "b"}, "mended"),
    ('{"a": "x,}", "b": [1 , ] , }', {"a": "x,}", "b": [1]}, "mended"),
    ('Here it is: {"a": {"b": 2,}} as asked', {"a": {"b": 2}}, "found"),
    ("the list [1, 2, ] is", {"items": [1, 2]}, "found"),
    ('{"k": 3, "device": {"os": "web"', {"k": 3, "device": {"os": "web"}}, "closed"),
    ('{"a": [{"b": "cut of', {"a": [{"b": "cut of"}]}, "closed"),
    ('{"a": [1, 2, ', {"a": [1, 2]}, "closed"),
    ('{"a": "quote \\" in }", "b": [', {"a": 'quote " in }', "b": []}, "closed"),
    ("nothing here", None, "lost"),
    ('{"a": }', None, "lost"),
]


def test_broken_json_is_salvaged(spark):
    rows = spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDEN)], "i int, x string").select("i", J.salvaged(F.col("x")).alias("s")).orderBy("i").collect()
    assert [(None if r.s.json is None else json.loads(r.s.json), r.s.how) for r in rows] == [g[1:] for g in GOLDEN]
    for text, found, _ in GOLDEN:
        got, _ = J.salvage(text)
        assert (None if got is None else json.loads(got)) == found


def test_salvage_is_linear_in_the_text():
    import time

    text = '{"a": [' + '{"b": "c, }"}, ' * 60_000
    start = time.process_time()
    got, how = J.salvage(text)
    assert how == "closed" and len(json.loads(got)["a"]) == 60_000 and time.process_time() - start < 20
