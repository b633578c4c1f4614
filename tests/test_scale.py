"""What several steps read is worked out once, and pairs and hops are made without holding or moving everything."""

import re

import pytest
from pyspark.sql import functions as F

from loamgraph.operators import blocksearch, entities, graph
from loamgraph.plans.registry import QUERIES
from loamgraph.streaming import store

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, source", [("fuzzy_candidates", "part"), ("auto_merge_flags", "part"), ("visible_graph", "lineitem"), ("graph_paths", "lineitem")])
def test_the_source_is_read_once(spark, name, source):
    assert not [f for f in QUERIES[name](spark, DATA).inputFiles() if f.endswith(f"/{source}.parquet")]


def test_pairs_within_groups_come_once(spark):
    rows = [(i, i % 3) for i in range(40)] + [(i, 1) for i in range(0, 40, 4)] + [(5, 2), (5, 2), (6, None), (99, None)]
    of = {k: {g for x, g in rows if x == k and g is not None} for k, _ in rows}
    want = sorted((a, b) for a in of for b in of if a < b and of[a] & of[b])
    found = entities.pairs_within(spark.createDataFrame(rows, "k long, g int"), "k", "g")
    assert sorted((r.a, r.b) for r in found.collect()) == want


def test_pairs_within_one_large_group_are_made_by_many_tasks(spark):
    one = spark.range(600).select(F.col("id").alias("k"), F.lit(1).alias("g"))
    per_task = [r["count"] for r in entities.pairs_within(one, "k", "g").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 600 * 599 // 2 and max(per_task) < sum(per_task) / 4


def test_neighbours_send_the_front_to_the_edges(spark, tmp_path):
    spark.range(3000).select(F.concat(F.lit("n"), F.col("id") % 50).alias("src"), F.concat(F.lit("n"), F.col("id") % 7 + 50).alias("dst")).write.parquet(str(tmp_path / "e"))
    edge = spark.read.parquet(str(tmp_path / "e"))
    found = graph.neighbours(edge, spark.createDataFrame([("n3",), ("n3",)], "id string"), 2)
    assert not [f for f in found.inputFiles() if str(tmp_path) in f]
    got = {r.id: r.distance for r in found.collect()}
    assert got == {"n3": 0} | {f"n{i + 50}": 1 for i in range(7)} | {f"n{i}": 2 for i in range(50) if i != 3}


def test_no_path_of_a_hub_is_left_out(spark):
    edge = [("hub", "A", f"n{i}") for i in range(150)] + [(f"n{i}", "B", "far") for i in range(150)] + [("hub", "A", "n0"), ("hub", "A", None), (None, "A", "hub"), ("hub", "L", "hub")]
    found = graph.paths(spark.createDataFrame(edge, "src string, rel_type string, dst string"), spark.createDataFrame([("hub",)], "id string"))
    got = found.groupBy("hops").count().collect()
    # one hop: 150 and the loop; two: 150 on to far, the loop and 150 either way round; three: back by 149 others, 150 to far after the loop
    assert {r.hops: r["count"] for r in got} == {1: 151, 2: 300, 3: 150 * 149 + 150}
    assert found.distinct().count() == 151 + 300 + 150 * 150


def test_texts_are_read_once_for_several_blocks_of_questions(spark, monkeypatch):
    monkeypatch.setattr(blocksearch, "QUESTIONS", 2)
    asked = spark.createDataFrame([(i, f"alpha beta w{i}") for i in range(5)], "qid long, text string")
    docs = spark.createDataFrame([(i, 0, "t", "d", f"w{i % 7} alpha gamma") for i in range(30)], "document_id long, chunk_index int, title string, doc_type string, content string")
    found = blocksearch.search(asked, docs, {"keyword": 3})
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {r.qid for r in found.collect()} == set(range(5))


def test_a_batch_of_a_store_is_worked_out_once(spark, tmp_path, monkeypatch):
    read = []
    replace = store.Store.replace
    monkeypatch.setattr(store.Store, "replace", lambda self, number, rows, ids: read.extend([*rows.inputFiles(), *ids.inputFiles()]) or replace(self, number, rows, ids))
    spark.createDataFrame([(i, "t", "d", f"text {i}") for i in range(20)], "document_id long, title string, doc_type string, content string").write.parquet(str(tmp_path / "docs"))
    store.Archive(spark, str(tmp_path / "archive"), 2).sync(0, spark.read.parquet(str(tmp_path / "docs")))
    assert read and not [f for f in read if str(tmp_path / "docs") in f]


def test_the_latest_touching_documents_are_found_in_steps(spark):
    touches = spark.createDataFrame([(d, f"P-{d % 4}") for d in range(1, 200)] + [(d, "S-1") for d in range(1, 200)] + [(7, "P-8")], "source_doc long, dst string")
    some = touches.filter("source_doc < 50 OR dst LIKE 'P%' AND source_doc < 60")
    wanted = spark.createDataFrame([("P-1",), ("P-2",), ("S-1",)], "dst string")
    want = [tuple(r) for r in some.join(wanted, "dst", "left_semi").groupBy("source_doc").agg(F.countDistinct("dst").alias("n")).orderBy(F.desc("source_doc")).limit(9).collect()]
    assert [tuple(r) for r in graph.latest_touching(some, wanted, 9, 3).collect()] == want
    assert len(graph.latest_touching(some, wanted, 500, 3).collect()) == some.join(wanted, "dst", "left_semi").select("source_doc").distinct().count()
    assert graph.latest_touching(some.limit(0), wanted, 9, 3).collect() == []


def test_document_detail_moves_assertions_twice(spark, request):
    key = "spark.sql.autoBroadcastJoinThreshold"
    request.addfinalizer(lambda value=spark.conf.get(key): spark.conf.set(key, value))
    spark.conf.set(key, "-1")
    plan = QUERIES["document_detail"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3


def test_edges_beside_an_id_count_once_for_each_row_of_a_node(spark):
    asserted = [("d1", "out", "A", "x"), ("d1", "out", "A", "x"), ("d1", "out", "B", "x"), ("d1", "in", "A", "x"), ("d1", "out", "A", "y"), ("d2", "out", "A", "gone"), ("d3", "out", None, "z"), ("d3", "out", None, "z"), ("d3", "out", "A", None)]
    node = [("x", "P"), ("y", "Q"), ("y", "Q"), ("y", "R"), ("z", None), (None, "P")]
    want = [("d1", 6, 2, "P,Q,R"), ("d3", 1, 1, "")]
    found = graph.beside(spark.createDataFrame(asserted, "id string, direction string, rel_type string, other string"), spark.createDataFrame(node, "id string, label string"))
    assert sorted(tuple(r) for r in found.collect()) == want


@pytest.mark.parametrize("chars", [1 << 20, 7])
def test_trigrams_of_texts(monkeypatch, chars):
    monkeypatch.setattr(blocksearch, "CHARS", chars)
    texts = ["", "a", "_", "ab c_d", "aaaa aaaa-aaab", "é日本 ß٣½ x\0y", "one two three " * 3, "\ud800z"]
    got = blocksearch.Trigrams(texts)
    words = [{f"  {w} " for w in re.findall(r"[^\W_]+", x)} for x in texts]
    want = sorted({(i, w[k : k + 3]) for i, ws in enumerate(words) for w in ws for k in range(len(w) - 2)})
    assert sorted((i, "".join(chr(c) if c else " " for c in g)) for i, g in zip(got.row.tolist(), got.gram.tolist())) == want
    assert got.n.tolist() == [sum(i == k for i, _ in want) for k in range(len(texts))]
