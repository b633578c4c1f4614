"""Rules beyond SQL against plain Python, and cases that the tables at hand do not hold."""

import datetime
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from loamgraph import streaming as S
from loamgraph.functions import chunks as C
from loamgraph.functions import dates as D
from loamgraph.functions import facts as X
from loamgraph.functions import fuzzy as Z
from loamgraph.functions import names as N
from loamgraph.functions import questions as Q
from loamgraph.operators import archive, blocksearch, entities, evidence, graph, resolution, search, status

DATA = "/root/testdata/sf0.001"


def values(spark, texts, *columns):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    return [tuple(r)[1:] for r in rows.select("i", *columns).orderBy("i").collect()]


def test_facts_equal_python(spark):
    odd = ["| a | b |\n| 1 |\n|x", "$1,200.50 and 30 % or 5 miles/h, 12 sq ft", "policy number: AB-1234, VIN 1HGCM82633A004352 K-10", "Total due: $45 and été 12 km", "", "no facts"]
    texts = odd + [r[0] for r in duckdb.execute(f"SELECT coalesce(text, '') FROM '{DATA}/documents.parquet'").fetchall()]
    x = F.col("x")
    got = values(spark, texts, X.table_rows(x), X.count(x, X.NUMERIC), X.count(x, X.IDENTIFIER), X.count(x, X.LABELLED))
    want = []
    for t in texts:
        rows = sum(1 for line in t.splitlines() if line.strip().startswith("|") and line.count("|") >= 2)
        want.append((rows, *(len(re.findall(p, t)) for p in (X.NUMERIC, X.IDENTIFIER, X.LABELLED))))
    assert got == want
    assert want[0][0] == 2 and want[1][1] >= 2 and want[2][2] >= 2 and want[3][3] == 1


def test_source_quality(spark):
    x = F.col("x")
    q = X.source_quality(F.lit("t"), F.lit("src"), x)
    got = [r[0] for r in values(spark, ["plain words", "invoice 12 km", "invoice summary", "lab requisition", "an overview"], q)]
    assert [(r.score, r.tier) for r in got] == [(0.58, "context"), (0.97, "original"), (0.77, "summary"), (0.48, "weak"), (0.58, "summary")]


def test_dates(spark):
    x = F.col("x")
    got = values(spark, ["on 2024-3-5", "3/5/2024", "in 1999", "none", "March 5, 2024", "Smarch 5, 2024"], D.date_key(x), D.summary_date(x))
    assert got == [("2024-03-05", None), ("2024-03-05", "2024-03-05"), ("1999", None), ("9999", None), ("2024", "2024-03-05"), ("2024", None)]
    text = "Date: 2024-01-02\nCollected on: 01/02/2024 \u00e9\ncollected on: 01/02/2024\nPolicy period: January 5, 2024\nseen 2023-05-06"
    assert values(spark, [text], D.source_date(x), D.recency_boost(x, F.lit(datetime.date(2024, 6, 1))))[0] == ("2024-01-02", 0.08)
    got = values(spark, [text], D.signals(x, F.lit("t"), F.lit("2020")))[0][0]
    assert got == {"specimen_date": ["01/02/2024"], "effective_date": ["January 5, 2024"], "statement_period": ["January 5, 2024"], "document_date": ["2020", "2024-01-02"], "mentioned_date": ["2024-01-02", "01/02/2024", "January 5, 2024", "2023-05-06"]}


def test_names(spark):
    x = F.col("x")
    names = ["SMITH, John", "Dr. Jane  Doe", "LLC Acme", "the thing is here", "N/A", "12,000", "verifying SSN", "FBI", "LONGCODEXYZ", None, ""]
    got = values(spark, names, N.name(x), N.valid_entity_name(x))
    assert [r[0] for r in got[:3]] == ["John SMITH", "Dr Jane Doe", "LLC Acme"]
    assert [r[1] for r in got] == [True, True, True, False, False, False, False, True, False, False, False]
    assert values(spark, ["Dr. Jane Doe", "AND Bob"], N.person_name(x)) == [("Jane Doe",), ("Bob",)]
    assert values(spark, ["January 5, 2024", "2024-01-02 - x", "Date of Issue: 2015-10-30", "Q1 2026", "May 1, 2024 - May 3, 2024", "Acme"], N.date_string(x)) == [(True,), (False,), (True,), (True,), (True,), (False,)]
    assert values(spark, ["27601", "12 Oak St", "Raleigh"], N.full_address(x)) == [(True,), (True,), (False,)]
    assert values(spark, ["date-event", "financialitem", "odd kind"], N.entity_type(x)) == [("Date-Event",), ("FinancialItem",), ("Odd Kind",)]


def test_modes_and_plans(spark):
    x = F.col("x")
    assert [r[0] for r in values(spark, ["fast", "STRICT", "high-stakes", "timeline", "x", "", None], Q.normalize_mode(x))] == ["quick", "strict", "strict", "timeline", "deep", "deep", "deep"]
    got = Q.with_retrieval_queries(spark.createDataFrame([("my insurance policy", "strict")], "text string, mode string")).first().asked
    assert [r.role for r in got] == ["primary", "current_state", "domain_inventory", "source_quality", "contradiction_check"]
    assert values(spark, ["bank tax loan"], Q.domain(x)) == [("mixed",)]


def table_text():
    rows = "\n".join(f"| {i} | {i * i} |" for i in range(900))
    return "Intro. " * 300 + "\n| n | square |\n| --- | --- |\n" + rows + "\nEnd.\n\n" + "word " * 900


@pytest.mark.parametrize("size, overlap", [(4000, 800), (500, 80), (50, 60)])
def test_chunks_cover_the_text(size, overlap):
    text = table_text()
    assert C.chunks("", size) == C.chunks(" \n", size) == C.chunks(None, size) == [] and C.chunks("a" * size, size) == ["a" * size]
    spans = list(C.windows(text, size, overlap))
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(b - a <= size for a, b in spans)
    assert all(p[0] < q[0] <= p[1] for p, q in zip(spans, spans[1:]))
    out = C.chunks(text, size, overlap)
    head = "| n | square |\n| --- | --- |\n"
    (start, end, found), = C.tables(text)
    assert found == head and text[start:end].startswith(head)
    if size > 100:
        assert len(out) == len(spans)
        for (a, _), c in zip(spans[1:], out[1:]):
            assert c.startswith(head) == (start < a < end)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_ratios():
    r = random.Random(2)
    for _ in range(300):
        a, b = ("".join(r.choice("abc d") for _ in range(r.randrange(12))) for _ in "ab")
        assert Z.common(a, b) == lcs(a, b)
    assert Z.ratio("", "") == 100 and round(Z.ratio("this is a test", "this is a test!"), 6) == round(2800 / 29, 6)
    assert Z.token_sort("fuzzy was a bear", "a bear was fuzzy") == 100 and Z.token_set("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert Z.token_set("", "a") == 0 and 0 < Z.token_set("a b", "b c") < 100
    assert Z.match_score("John Smith", "SMITH, John", True) == 1 and Z.parts_score("j smith", "john smith") > 0.85
    assert Z.first_names_fit("Wm Smith", "William Smith") and not Z.first_names_fit("Blake Smith", "Chelsea Smith")


def test_candidates_lose_no_pair(spark):
    r = random.Random(7)
    words = ["red", "blue", "green", "steel", "copper", "lime", "limed", "steal", "bluegreen"]
    names = sorted({" ".join(r.choice(words) for _ in range(r.randrange(1, 4))) for _ in range(90)} | {"a", "b", "ab", "aaaa", "aaaab"})
    docs = spark.createDataFrame([("L", n) for n in names] + [("M", names[0]), ("L", None)], "label string, name string")
    got = {(x.a, x.b, round(x.score, 4)) for x in entities.candidates(docs).collect()}
    want = {(a, b, round(s, 4)) for i, a in enumerate(names) for b in names[i + 1 :] if (s := Z.token_sort(a, b)) >= entities.LEAST - 1e-9}
    assert got == want and len(want) > 20


def test_groups_and_safeguards(spark):
    links = spark.createDataFrame([("b", "a"), ("b", "c"), ("d", "c"), ("x", "y")], "a string, b string")
    assert {tuple(x) for x in entities.groups(links).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "x"), ("y", "x")}
    pairs = spark.createDataFrame([("Jo", "Joan"), ("Blake Smith", "Chelsea Smith"), ("Wm Smith", "William Smith"), ("Ann", "Ann Lee"), ("Anna Lee", "Ann Lee")], "a string, b string")
    assert [x[0] for x in pairs.select(entities.may_merge(F.col("a"), F.col("b"), F.lit(0.9), True)).collect()] == [False, False, True, False, True]
    pairs = spark.createDataFrame([("Acme Bank", "Acme Trust"), ("First Bank", "Second Bank")], "a string, b string")
    assert [x[0] for x in pairs.select(entities.may_merge(F.col("a"), F.col("b"), F.lit(0.9), False)).collect()] == [True, False]


def named_apart_from_documents(con):
    return sorted(con.execute("SELECT DISTINCT * FROM (SELECT 'Location' AS label, r_name AS name FROM region UNION ALL SELECT 'Location', n_name FROM nation UNION ALL SELECT 'Person', c_name FROM customer UNION ALL SELECT 'Organization', s_name FROM supplier UNION ALL SELECT 'Product', p_name FROM part) WHERE name IS NOT NULL").fetchall())


def test_names_of_all_labels_are_judged_and_grouped(spark):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    names = named_apart_from_documents(con)
    want = {(x, a, b, round(Z.match_score(a, b, x == "Person"), 6)) for x, a in names for y, b in names if x == y and a < b and Z.token_sort(a, b) >= entities.LEAST - 1e-9}
    rows = spark.createDataFrame(sorted(want), "label string, a string, b string, best double")
    a, b, best = F.col("a"), F.col("b"), F.col("best")
    merge = F.when(F.col("label") == "Person", entities.may_merge(a, b, best, True)).otherwise(entities.may_merge(a, b, best, False))
    want = {tuple(r) for r in rows.withColumn("merge", merge).collect()}
    got = [tuple(r) for r in entities.auto_merge_flags(spark, DATA).collect()]
    assert len(got) == len(want) and set(got) == want and {r[0] for r in got} == {"Person", "Organization", "Product", "Location"}
    reached = {}
    for _, a, b, _, ok in want:
        if ok:
            both = reached.setdefault(a, {a}) | reached.setdefault(b, {b})
            reached |= dict.fromkeys(both, both)
    assert {tuple(r) for r in entities.resolve_components(spark, DATA).collect()} == {(n, min(of)) for n, of in reached.items()} and len(reached) > 100


def test_flags_of_persons_and_others(spark):
    pairs = [("Person", "Jo", "Joan"), ("Person", "Carl Smithsonian", "Otto Smithsonian"), ("Person", "John Smithson", "Joan Smithson"), ("Person", "Anna Lee", "Ann Lee"), ("Person", "Smithson", "Smithsons"), ("Organization", "Acme Bank", "Acme Banks"), ("Organization", "First Bank", "Fist Banks"), ("Product", "steels", "steel"), ("Product", "aluminium", "Aluminium")]
    frame = spark.createDataFrame(pairs, "label string, a string, b string")
    got = {r.a: (r.best, r.merge) for r in entities.flagged(frame, frame.selectExpr("explode(array(a, b)) AS name")).collect()}
    pairs = [x for x in pairs if Z.token_sort(*x[1:]) >= entities.LEAST]
    assert set(got) == {a for _, a, _ in pairs} and len(pairs) > 3
    for label, a, b in pairs:
        best = round(Z.match_score(a, b, label == "Person"), 6)
        merge = frame.limit(1).select(entities.may_merge(F.lit(a), F.lit(b), F.lit(best), label == "Person")).first()[0]
        assert got[a] == (best, merge)


def test_thinned_links_connect_the_same(spark):
    links = spark.createDataFrame([(f"n{i:03}", f"n{j:03}") for i in range(60) for j in range(i, 60) if i % 3 == j % 3], "a string, b string").repartition(2)
    thin = entities.thinned(links)
    assert thin.count() <= 2 * 57
    assert {tuple(r) for r in entities.groups(thin).collect()} == {tuple(r) for r in entities.groups(links.filter("a <> b")).collect()}


def test_diversified_keeps_its_bounds(spark):
    r = random.Random(3)
    rows = [(q, p, r.randrange(12), r.random() < 0.4, r.random()) for q in range(3) for p in range(1, 120)]
    got = evidence.diversified(spark.createDataFrame(rows, "item_id long, position long, document_id long, graph boolean, similarity double"), 20, 2).collect()
    for q in range(3):
        mine = [x for x in got if x.item_id == q]
        assert len(mine) == 20 and all(sum(y.document_id == x.document_id for y in mine) <= 2 for x in mine)
        assert sorted(x.place for x in mine) == list(range(1, 21))
        best, count = [], {}
        for _, p, d, from_graph, _ in sorted((x for x in rows if x[0] == q), key=lambda x: x[1]):
            if not from_graph and count.get(d, 0) < 2 and len(best) < 10:
                best.append(p)
                count[d] = count.get(d, 0) + 1
        assert [x.position for x in sorted(mine, key=lambda x: x.place)][:10] == best


def test_literal_matches_of_long_texts(spark):
    long = "filler words here " * 400 + "the exact Phrase wanted stands here" + " more filler" * 300
    docs = spark.createDataFrame([(1, "t", long, "s"), (2, "t", "other words", "s"), (3, "t", "cat", "s"), (4, "t", "", "s"), (5, "t", "concatenate", "s")], "document_id long, title string, content string, doc_type string")
    asked = spark.createDataFrame([(10, "exact phrase wanted stands"), (11, "CAT"), (12, "act phrase wanted sta"), (13, ""), (14, "!!")], "item_id long, text string")
    found = blocksearch.literal_matches(asked.withColumnRenamed("item_id", "qid"), docs.withColumn("chunk_index", F.lit(0)))
    assert {tuple(x) for x in found.select("qid", "document_id").collect()} == {(10, 1), (12, 1), (11, 3), (11, 5)}
    top = search.keyword_search(asked, docs, 15).filter("item_id = 10").orderBy("rank").collect()
    assert (top[0].document_id, top[0].rank_score) == (1, 1.0)


@pytest.mark.parametrize("vectors", [blocksearch.VECTORS, 7])
def test_nearest_vectors_equal_brute_force(spark, monkeypatch, vectors):
    monkeypatch.setattr(blocksearch, "VECTORS", vectors)
    r = random.Random(3)
    data = [(i, [float(r.randrange(-3, 4)) for _ in range(4)], i % 3) for i in range(60)]
    data += [(100, [0.0, 0.0], 1), (101, [1.0, 0.0], 1), (102, [1.0], 1), (103, None, 1), (104, [3.0, 4.0], None), (105, [None, 4.0], 1), (106, [], 2)]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(3)

    def cosine(a, b):
        a, b = ([x or 0.0 for x in v or []] for v in (a, b))
        if len(a) != len(b) or not any(a) or not any(b):
            return 0.0
        return round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b)), 6)

    for group in (None, "label"):
        got = blocksearch.nearest(rows, rows.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), "label"), 5, group).collect()
        want = set()
        for q, a, c in data:
            if q % 5 == 0:
                some = sorted((-cosine(a, b), i) for i, b, d in data if group is None or c is not None and c == d)[:5]
                want |= {(q, i, -s, rank) for rank, (s, i) in enumerate(some, 1)}
        assert {(x.query_id, x.vec_id, x.similarity, x["rank"]) for x in got} == want and len(got) == len(want)


def test_blocks_of_questions_and_texts(spark, monkeypatch):
    monkeypatch.setattr(blocksearch, "QUESTIONS", 2)
    monkeypatch.setattr(blocksearch, "TEXTS", 3)
    texts = [(i, i % 2, f"title {i}", "medical", f"blood test w-2/{i} no. {i % 4} prior version" if i % 3 else None) for i in range(20)]
    docs = spark.createDataFrame(texts, "document_id long, chunk_index int, title string, doc_type string, content string").repartition(4)
    asked = spark.createDataFrame([(1, "blood test w-2"), (2, ""), (3, None), (4, "title 7 w-2/7"), (5, "doctor no. 3")], "qid long, text string")
    got = blocksearch.search(asked, docs, {"keyword": 4, "cosine": 3, "hybrid": 2}).collect()
    assert {(x.qid, x.list) for x in got} == {(q, n) for q in (1, 4, 5) for n in ("keyword", "cosine", "hybrid")}
    assert [(x.document_id, x.exact) for x in sorted(got, key=lambda x: x["rank"]) if (x.qid, x.list) == (1, "keyword")] == [(1, True), (2, True), (4, True), (5, True)]
    assert next(x.document_id for x in got if (x.qid, x.list, x["rank"]) == (4, "cosine", 1)) == 7
    assert blocksearch.search(asked.limit(0), docs, {"keyword": 4}).collect() == [] and blocksearch.search(asked, docs.limit(0), {"keyword": 4}).collect() == []


def test_repair_leaves_no_drift(spark):
    ids = lambda x: spark.createDataFrame([(i,) for i in x], "document_id long")
    source, stores = ids([1, 2, 3, 4]), {"graph": ids([1, 2, 9]), "hash": ids([2, 3, 3])}
    found = archive.drift(source, stores)
    assert {tuple(x) for x in found.collect()} == {(3, "graph", "missing"), (4, "graph", "missing"), (9, "graph", "extra"), (1, "hash", "missing"), (4, "hash", "missing")}
    todo = archive.repair_targets(found)
    fixed = {k: v.join(todo.filter("action = 'delete'"), "document_id", "left_anti").select("document_id").unionByName(todo.filter("action = 'reindex'").select("document_id")) for k, v in stores.items()}
    assert archive.drift(source, fixed).count() == 0 and archive.drift(ids([]), {"graph": ids([])}).count() == 0


def test_taking_a_document_out(spark):
    node = spark.createDataFrame([("doc-1", "Document", "a"), ("doc-2", "Document", "b"), ("P-1", "Product", "x"), ("P-2", "Product", "y")], "id string, label string, name string")
    said = spark.createDataFrame([("doc-1", "MENTIONS", "P-1", 1), ("doc-1", "MENTIONS", "P-2", 1), ("doc-2", "MENTIONS", "P-2", 2)], "src string, rel_type string, dst string, source_doc long")
    left, edges = graph.without_document(node, said, 1)
    assert sorted(r.id for r in left.collect()) == ["P-2", "doc-2"] and [tuple(r) for r in edges.collect()] == [("doc-2", "MENTIONS", "P-2", 2)]


def test_stream_keeps_the_last_version(spark, tmp_path):
    day = lambda n: datetime.datetime(2024, 1, n)
    batches = [[(1, "a", day(1)), (2, "b", day(1)), (1, "a2", day(3))], [(1, "late", day(2)), (2, "b", day(5)), (3, None, None)], [(3, "c", day(1)), (3, "c", day(1))]]
    path = f"file://{tmp_path}/out"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, S.DOCUMENTS).coalesce(1).write.parquet(f"{tmp_path}/in/b{i}")
        S.sync(spark.readStream.schema(S.DOCUMENTS).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"), path)
    got = {r.document_id: (r.content, r.version) for r in S.read_state(spark, path, 2).collect()}
    assert got == {1: ("a2", 1), 2: ("b", 1), 3: ("c", 2)}


def test_joint_names(spark):
    x = F.col("x")
    texts = ["Blake & Chelsea McCarn", "Blake T and Chelsea J McCarn", "BLAKE T MCCARN CHELSEA J MCCARN", "Doe Ann Kay & Doe Bob Lee", "Ann Doe", "One Two Three Four Five", ""]
    assert values(spark, texts, N.joint(x)) == [
        (["Blake McCarn", "Chelsea McCarn"],), (["Blake T McCarn", "Chelsea J McCarn"],), (["BLAKE T MCCARN", "CHELSEA J MCCARN"],), (["Doe Ann Kay", "Doe Bob Lee"],),
        (["Ann Doe"],), (["One Two Three Four Five"],), ([""],),
    ]
    assert resolution.people(spark.createDataFrame([(None,), (" ",)], "name string")).count() == 0


def test_resolving_organisations(spark):
    known = spark.createDataFrame([("a", "Acme Rockets", ["Acme Rocketry"]), ("b", "Globex Partners", None)], "id string, name string, aliases array<string>")
    named = spark.createDataFrame([(n,) for n in ["ACME ROCKETS", "acme rocketry", "Acme Rockets Inc", "Initech Systems", "initech systems", "ab", None, "Globex Partners"]], "name string")
    got = {r.name: (r.id, r.how) for r in resolution.resolve_organisations(named, known).collect()}
    assert got == {
        "ACME ROCKETS": ("a", "exact"), "acme rocketry": ("a", "exact"), "Acme Rockets Inc": ("a", "alike"), "Globex Partners": ("b", "exact"),
        "Initech Systems": ("new:initech systems", "created"), "initech systems": ("new:initech systems", "created"),
    }
    assert resolution.resolve_organisations(named, known.limit(0)).filter("how <> 'created'").count() == 0


def test_scores_of_cases(spark):
    schema = "id long, answer string, required_terms array<string>, required_docs array<long>, docs array<long>, confidence double, trust double, min_trust double"
    rows = [(1, "The Due date", ["due"], [3], [3, 4], 0.4, 0.5, 0.5), (2, None, ["due"], [3, 2], None, 0.9, None, None), (3, "x", None, None, None, 0.2, None, None), (4, "x", None, None, None, 0.35, 0.1, 0.2)]
    got = {r.id: (r.missing_terms, r.missing_docs, r.passed) for r in status.score_cases(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: ([], [], True), 2: (["due"], [2, 3], False), 3: ([], [], False), 4: ([], [], False)}


def test_export_reads_back(spark, tmp_path):
    tables = {"a": spark.range(3), "b": spark.range(0)}
    assert {tuple(r) for r in resolution.export(tables, f"file://{tmp_path}/out").collect()} == {("a", 3), ("b", 0)}
