"""Retrieval over plans: merging in order, diversity, evidence rows and the recency of texts, against plain Python."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from loamgraph.functions import dates as D
from loamgraph.operators import blocksearch
from loamgraph.operators import retrieval as R
from loamgraph.operators import vector_index as V
from loamgraph.session import settled, shared_path


def test_recency_counts_dated_texts_only(spark):
    texts = ["Date: 2024-05-20\nx", "Date: 2023-09-01", "y\nDate: 2022-08-01 late", "Date: 2020-01-01", "Date: unknown", "", "Date: 2030-01-01"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select(D.recency_boost(F.col("x"), F.lit("2024-06-01").cast("date")).alias("b"), "i")
    assert [r.b for r in rows.orderBy("i").collect()] == [0.12, 0.08, 0.04, 0.0, 0.0, 0.0, 0.12]


def context(spark, seed, positions):
    r = random.Random(seed)
    rows, seen = [], set()
    for _ in range(160):
        k = (r.randrange(2), r.choice(["vector", "keyword"]), r.choice(positions))
        rows.append((*k, sum(x[:3] == k for x in rows) + 1, r.randrange(9), r.randrange(3), float(r.randrange(10)), False))
        seen.add(k)
    return rows


SCHEMA = "item_id long, list string, position int, ordinal int, document_id long, chunk_index int, score double, graph boolean"


def test_contexts_merge_in_order(spark):
    rows = context(spark, 1, [1, 2, 3])
    want, seen, n = {}, set(), defaultdict(int)
    for x in sorted(rows, key=lambda x: (x[2], x[3])):
        if (x[0], x[1], x[4], x[5]) not in seen:
            seen.add((x[0], x[1], x[4], x[5]))
            n[x[:2]] += 1
            want[(*x[:2], n[x[:2]])] = (*x[4:],)
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r)[:3]: tuple(r)[3:] for r in R.merged(frame).collect()}
    assert got == want
    pairs = R.merge_contexts(R.merge_contexts(R.merged(frame.filter("position = 1")), R.merged(frame.filter("position = 2"))), R.merged(frame.filter("position = 3")))
    assert {tuple(r)[:3]: tuple(r)[3:] for r in pairs.collect()} == want


def greedy(rows, limit, cap):
    """(document, rank) in the order taken, one chunk after the other."""
    taken, count, seen = [], defaultdict(int), set()

    def take(x):
        taken.append(x)
        count[x[1]] += 1
        seen.add(x[1])

    for x in [x for x in rows if not x[2]]:
        if count[x[1]] < cap:
            take(x)
        if len(taken) >= limit // 2:
            break
    for x in sorted((x for x in rows if x[2]), key=lambda x: -x[3]):
        if x[1] not in seen and count[x[1]] < cap:
            take(x)
        if len(taken) >= limit:
            break
    if len(taken) < limit:
        for x in [x for x in rows if x not in taken]:
            if count[x[1]] < cap:
                take(x)
            if len(taken) >= limit:
                break
    return [(x[1], x[0]) for x in taken]


def test_diversity_is_greedy(spark):
    r = random.Random(7)
    rows, want = [], {}
    for item in range(60):
        n, limit, cap = r.randrange(1, 60), r.choice([2, 4, 10, 36]), r.choice([1, 2, 4])
        share = r.choice([0, 0.2, 0.6, 1])
        mine = [(rank, r.randrange(12), r.random() < share, r.randrange(1000) / 1000) for rank in range(1, n + 1)]
        want[item] = greedy(mine, limit, cap)
        rows += [(item, *x, limit, cap) for x in mine]
    frame = spark.createDataFrame(rows, "item_id long, rank int, document_id long, graph boolean, similarity double, most int, each int")
    got = defaultdict(list)
    for x in R.diversified(frame, F.col("most"), F.col("each")).orderBy("place").collect():
        got[x.item_id].append((x.document_id, x["rank"]))
    assert dict(got) == want


def test_evidence_rows_hold_neighbours_and_whole_documents(spark):
    words = "insurance policy number AB-1234 premium $1,200.50 due"
    docs = spark.createDataFrame([(d, f"Policy {d}", f"{words} {d} " * 400, "insurance", "2024-05-20") for d in range(4)] + [(9, "Other", "nothing", "x", None)], "document_id long, title string, content string, doc_type string, date string")
    questions = spark.createDataFrame([(1, "what is my insurance policy premium", "strict"), (2, "where is the house", "quick"), (3, None, "deep")], "item_id long, text string, mode string").fillna("", ["text"])
    chunks = R.passages(docs)
    empty = spark.createDataFrame([], "entity_id long, name string, label string")
    found = R.retrieved(questions, chunks, empty, R.links(docs))
    as_of = F.lit("2024-06-01").cast("date")
    ranked = settled(R.combined(found, chunks, questions, as_of))
    sources = settled(R.sources(ranked))
    held = settled(R.evidence_rows(ranked, sources, chunks, docs, questions, chunks, as_of))
    rows = held.collect()
    mine = [r for r in rows if r.item_id == 1]
    assert {r.document_id for r in mine} == {0, 1, 2, 3} and sorted(r.place for r in mine) == list(range(1, len(mine) + 1)) and len(mine) <= 90
    assert any(r.chunk_index >= R.WHOLE for r in mine) and len({(r.document_id, r.chunk_index) for r in mine}) == len(mine)
    assert not [r for r in rows if r.item_id == 2 and r.chunk_index >= R.WHOLE]
    assert [r.score for r in sorted(mine, key=lambda r: r.place)] == sorted((r.score for r in mine), reverse=True)
    items = settled(R.evidence_pack(held))
    assert {r.exact_term_hits > 0 for r in items.filter("item_id = 1").collect()} == {True}
    graded = {r.item_id: r for r in R.grades(items, sources, questions).collect()}
    assert set(graded) == {1, 2, 3} and graded[1].score > graded[3].score and graded[1].audit_status == "verifier_unavailable"
    summary = {r.item_id: r for r in R.source_summary(items, sources).collect()}
    assert (summary[1].source_count, summary[1].latest_retrieved, summary[1].latest) == (sources.filter("item_id = 1").count(), "2024-05-20", "2024-05-20")


def test_lists_hold_every_row_and_recall_is_measured(spark, monkeypatch):
    monkeypatch.setattr(blocksearch, "VECTORS", 50)
    r = random.Random(1)
    centre = [[r.gauss(0, 1) for _ in range(8)] for _ in range(20)]
    data = [(i, [x + r.gauss(0, 0.2) for x in centre[i % 20]]) for i in range(600)] + [(900, None), (901, [0.0] * 8), (902, [1.0])]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    queries = rows.filter("vec_id % 30 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    centres = V.learn(rows, 16)
    index = V.build(rows, centres, shared_path(spark, "index"))
    assert sorted(x.id for x in index.collect()) == [i for i, _ in data] and index.select("list").distinct().count() > 8
    n, found = V.probes_for(index, rows, queries, centres, 5)
    assert n < 16 and found >= 0.9
    true = {(x.query_id, x.vec_id): x.similarity for x in blocksearch.nearest(rows, queries, 5).collect()}
    got = {(x.query_id, x.vec_id): x.similarity for x in V.search(index, queries, centres, 5, n).collect()}
    assert len(true.keys() & got.keys()) >= 0.9 * len(true) and all(true.get(k, v) == v for k, v in got.items())
    every = {(x.query_id, x.vec_id) for x in V.search(index, queries, centres, 5, len(centres)).collect()}
    assert every == set(true)
