"""Retrieval over the plans of many questions: sub-questions searched together, results merged in order, sources, and evidence packs.

A context is rows of (item_id, list, ordinal, document_id, chunk_index, score, graph): for each
question four ordered lists, ``vector``, ``keyword``, ``entity`` and ``entity_keyword`` (whose
document_id is an entity's). All questions and sub-questions are one job; every list is bounded
by the limits of its sub-questions, so the windows below hold a few hundred rows of a question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamgraph.functions import dates as D
from loamgraph.functions import facts as X
from loamgraph.functions import questions as Q
from loamgraph.functions import text as T
from loamgraph.operators import blocksearch as B
from loamgraph.operators import evidence as E
from loamgraph.operators import planning as P
from loamgraph.session import settled
from loamgraph.sources.bindings import source_documents, table

#: Rows that a full and a light search take of each list.
LIMITS = {"vector": (20, 15), "keyword": (15, 10), "entity": (8, 5), "entity_keyword": (8, 5)}
FULL = ["primary", "current_state"]
#: Latest documents of an organisation, and documents by entity types, that a broad question adds.
PER_ORGANISATION, BY_TYPE = 3, 40
#: Chunks that sources are made of, sources, and characters of an excerpt.
CHUNKS, SOURCES, EXCERPT = 25, 15, 300
CONTEXT = ["item_id", "list", "ordinal", "document_id", "chunk_index", "score", "graph"]
#: Chunk numbers of whole documents' chunks begin here.
WHOLE = 100_000
# Weights of ranking.
VECTOR, KEYWORD, TITLE, CONTENT, SOURCE, SOURCE_STEP, WHOLE_BOOST, WHOLE_SCORE, NEIGHBOUR_SCORE = 0.7, 0.3, 0.18, 0.05, 0.35, 0.025, 0.22, 0.78, 0.5


def subquestions(questions: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """item_id, position (from 1), role, query of questions (item_id, text, mode): the planned ones, one for the latest state where none is planned, then ``more`` (item_id, seq, query), as of a model's decomposition, for broad questions."""
    rows = Q.with_retrieval_queries(questions.select("item_id", "text", Q.normalize_mode(F.col("mode")).alias("mode")))
    latest = F.struct(F.lit("current_state").alias("role"), F.trim(F.concat("text", F.lit(T.LATEST_SUFFIX))).alias("query"))
    wants = (F.col("mode") != "quick") & Q.requires_latest(F.col("text")) & ~F.exists("asked", lambda x: x["role"] == "current_state")
    out = rows.select("item_id", F.posexplode(F.when(wants, F.array_append("asked", latest)).otherwise(F.col("asked"))).alias("p", "s")).select("item_id", (F.col("p") + 1).cast("long").alias("position"), "s.role", "s.query")
    if more is None:
        return out
    broad = rows.filter(Q.broad(F.col("text")) & (F.col("mode") != "quick")).select("item_id")
    return out.unionByName(more.join(broad, "item_id", "left_semi").select("item_id", (1000 + F.col("seq")).cast("long").alias("position"), F.lit("decomposed").alias("role"), "query"))


def searched(subs: DataFrame, chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """Results of sub-questions: CONTEXT with their position; ordinal is the rank in the list of a sub-question.

    chunks: document_id, chunk_index, title, doc_type, content; entities: entity_id, name, label.
    """
    numbered = subs.withColumn("qid", F.col("item_id") * 4096 + F.col("position"))  # positions stay far below
    asked = numbered.select("qid", F.col("query").alias("text"))
    most = {name: max(both) for name, both in LIMITS.items()}
    found = B.search(asked, chunks, {"cosine": most["vector"], "keyword": most["keyword"]}).withColumn("list", F.when(F.col("list") == "cosine", "vector").otherwise("keyword"))
    named = entities.select(F.col("entity_id").alias("document_id"), F.lit(0).alias("chunk_index"), F.col("name").alias("title"), F.col("label").alias("doc_type"), F.concat_ws(" ", "label", "name").alias("content"))
    of_entities = B.search(asked, named, {"cosine": most["entity"], "keyword": most["entity_keyword"]}, F.concat_ws(" ", "doc_type", "title")).withColumn("list", F.when(F.col("list") == "cosine", "entity").otherwise("entity_keyword"))
    light = F.create_map(*[F.lit(x) for name, both in LIMITS.items() for x in (name, both[1])])
    score = F.when(F.col("list").isin("vector", "entity"), F.col("cosine")).when(F.col("exact"), 1.0).otherwise(F.col("similarity"))
    rows = found.unionByName(of_entities).select((F.col("qid") / 4096).cast("long").alias("item_id"), (F.col("qid") % 4096).alias("position"), "list", F.col("rank").alias("ordinal"), "document_id", "chunk_index", score.alias("score"), F.lit(False).alias("graph"))
    return rows.join(subs.select("item_id", "position", "role"), ["item_id", "position"]).filter(F.col("role").isin(FULL) | (F.col("ordinal") <= F.element_at(light, F.col("list")))).drop("role")


def merged(results: DataFrame) -> DataFrame:
    """CONTEXT of the results of all sub-questions: each chunk or entity once in its list, as it comes first by position and rank."""
    first = W.partitionBy("item_id", "list", "document_id", "chunk_index").orderBy("position", "ordinal")
    once = results.withColumn("n", F.row_number().over(first)).filter("n = 1")
    return once.withColumn("ordinal", F.row_number().over(W.partitionBy("item_id", "list").orderBy("position", "ordinal"))).select(*CONTEXT)


def merge_contexts(one: DataFrame, other: DataFrame) -> DataFrame:
    """The lists of two contexts one after the other, without what the first has already."""
    return merged(one.withColumn("position", F.lit(1)).unionByName(other.withColumn("position", F.lit(2))))


def graph_documents(questions: DataFrame, links: DataFrame, chunks: DataFrame) -> DataFrame:
    """CONTEXT of broad questions from the graph: of documents of relevant organisations and entity types as many chunks as there are such documents, by the cosine of their terms.

    links: document_id, organisation, labels (of the entities that the document mentions).
    """
    asked = questions.filter(Q.broad(F.col("text")) & (Q.normalize_mode(F.col("mode")) != "quick")).select("item_id", "text", Q.entity_types(F.col("text")).alias("types"))
    latest = links.filter("organisation IS NOT NULL").withColumn("n", F.row_number().over(W.partitionBy("organisation").orderBy(F.desc("document_id")))).filter(F.col("n") <= PER_ORGANISATION)
    mentions = links.select("document_id", "organisation", F.explode("labels").alias("type"))
    types = asked.select("item_id", F.explode("types").alias("type"))
    wanted = mentions.select("organisation", "type").distinct().join(types, "type").select("item_id", "organisation").distinct()
    organisations = latest.select("organisation").distinct()
    everything = asked.filter(F.size("types") == 0).select("item_id")
    wanted = wanted.unionByName(everything.crossJoin(organisations))  # questions without a type take every organisation
    by_organisation = latest.join(wanted, "organisation").select("item_id", "document_id")
    touched = mentions.join(types, "type").groupBy("item_id", "document_id").agg(F.countDistinct("type").alias("n"))
    by_type = touched.withColumn("r", F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("n"), F.desc("document_id")))).filter(F.col("r") <= BY_TYPE).select("item_id", "document_id")
    ids = by_organisation.unionByName(by_type).distinct()
    head = F.concat_ws(" ", F.lower("title"), F.lower("doc_type"), F.lower(F.substring("content", 1, B.HEAD)))
    terms = chunks.join(ids.select("document_id").distinct(), "document_id", "left_semi").select("document_id", "chunk_index", T.signal_terms(head).alias("held"))
    pairs = ids.join(terms, "document_id").join(asked.select("item_id", T.query_terms(F.col("text")).alias("terms")), "item_id")
    cosine = F.round(F.size(F.array_intersect("terms", "held")) / F.sqrt(F.greatest(F.size("terms") * F.size("held"), F.lit(1)).cast("double")), 6)
    ranked = pairs.select("item_id", "document_id", "chunk_index", cosine.alias("score")).withColumn("ordinal", F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), "document_id", "chunk_index")))
    counts = ids.groupBy("item_id").agg(F.count("*").alias("most"))
    return ranked.join(counts, "item_id").filter("ordinal <= most").select("item_id", F.lit("vector").alias("list"), "ordinal", "document_id", "chunk_index", "score", F.lit(True).alias("graph"))


def retrieved(questions: DataFrame, chunks: DataFrame, entities: DataFrame, links: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """CONTEXT of questions (item_id, text, mode): their sub-questions' results in order, then the graph's."""
    graph = graph_documents(questions, links, chunks).withColumn("position", F.lit(4095).cast("long"))
    return merged(searched(subquestions(questions, more), chunks, entities).unionByName(graph))


def combined(context: DataFrame, chunks: DataFrame, questions: DataFrame, as_of: Column) -> DataFrame:
    """Chunks of a context with their scores and rank: item_id, question, document_id, chunk_index, title, doc_type, content, vector_score, keyword_score, combined, rerank, rank, graph."""
    of = lambda name: F.when(F.col("list") == name, F.col("score"))
    first = F.min(F.when(F.col("list") == "vector", F.col("ordinal")).otherwise(1_000_000 + F.col("ordinal")))
    scored = context.filter(F.col("list").isin("vector", "keyword")).groupBy("item_id", "document_id", "chunk_index").agg(
        F.coalesce(F.max(of("vector")), F.lit(0.0)).alias("vector_score"), F.coalesce(F.max(of("keyword")), F.lit(0.0)).alias("keyword_score"), first.alias("first"), F.bool_or("graph").alias("graph")
    )
    rows = scored.join(chunks, ["document_id", "chunk_index"]).join(questions.select("item_id", F.col("text").alias("question")), "item_id")
    return reranked(rows.withColumn("combined", F.round(VECTOR * F.col("vector_score") + KEYWORD * F.col("keyword_score"), 7)), as_of)


def reranked(rows: DataFrame, as_of: Column) -> DataFrame:
    """Adds rerank and rank to rows with question, title, doc_type, content, combined and first; ties as they came."""
    head = F.concat_ws(" ", F.lower("title"), F.lower("doc_type"), F.lower(F.substring("content", 1, B.HEAD)))
    hits = F.size(F.array_intersect(T.query_terms(F.col("question")), T.signal_terms(head)))
    boost = F.lit(0.0)
    for terms, types, value in reversed(B.BOOSTS):
        boost = F.when(T.contains_any(F.col("question"), terms) & T.contains_any(F.col("doc_type"), types), value).otherwise(boost)
    score = F.col("combined") + boost + D.recency_boost(F.col("content"), as_of) + B.HIT * hits - F.when(T.contains_any(F.col("content"), T.SUPERSEDED), B.OLD).otherwise(0.0)
    order = W.partitionBy("item_id").orderBy(F.desc("rerank"), "first", "document_id", "chunk_index")
    return rows.withColumn("rerank", F.round(score, 7)).withColumn("rank", F.row_number().over(order))


def sources(ranked: DataFrame) -> DataFrame:
    """Up to SOURCES sources of each question from its CHUNKS best chunks, a document each: item_id, place, document_id, chunk_index, similarity, title, doc_type, date, date_signals, quality, excerpt_count, excerpt."""
    of_document = W.partitionBy("item_id", "document_id")
    top = ranked.filter(F.col("rank") <= CHUNKS)
    top = top.withColumn("n", F.row_number().over(of_document.orderBy(F.desc("combined"), "rank"))).withColumn("excerpt_count", F.count("*").over(of_document)).withColumn("came", F.min("rank").over(of_document))
    best = top.filter("n = 1").withColumn("place", F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("combined"), "came"))).filter(F.col("place") <= SOURCES)
    date = D.source_date(F.col("content"))
    quality = X.source_quality(F.col("title"), F.col("doc_type"), F.col("content"))
    return best.select("item_id", "place", "document_id", "chunk_index", F.col("combined").alias("similarity"), "title", "doc_type", date.alias("date"), D.signals(F.col("content"), F.col("title"), date).alias("date_signals"), quality.alias("quality"), "excerpt_count", F.substring("content", 1, EXCERPT).alias("excerpt"))


def diversified(ranked: DataFrame, limit: Column, per_document: Column) -> DataFrame:
    """Of ranked chunks (item_id, rank, document_id, graph, similarity) at most ``limit`` of a question and ``per_document`` of a document, with their place.

    First half the limit of those not from the graph, by rank; then, by similarity, one chunk from
    the graph of each document not taken yet; then what is left, by rank.
    """
    nth = lambda *keys: W.partitionBy("item_id", *keys)
    rows = ranked.withColumn("limit", limit).withColumn("cap", per_document)
    rows = rows.withColumn("n", F.when(~F.col("graph"), F.row_number().over(nth("document_id", "graph").orderBy("rank"))))
    rows = rows.withColumn("a", F.when(F.col("n") <= F.col("cap"), F.count_if(F.col("n") <= F.col("cap")).over(nth().orderBy("rank"))))
    half = F.greatest(F.lit(1), F.floor(F.col("limit") / 2))
    rows = rows.withColumn("one", F.coalesce(F.col("a") <= half, F.lit(False)))
    held = F.count_if("one").over(nth("document_id"))
    fresh = F.row_number().over(nth("document_id", "graph").orderBy(F.desc("similarity"), "rank"))
    rows = rows.withColumn("b", F.col("graph") & (held == 0) & (fresh == 1))
    rows = rows.withColumn("taken", F.count_if("one").over(nth())).withColumn("b_at", F.when(F.col("b"), F.count_if("b").over(nth().orderBy(F.desc("similarity"), "rank"))))
    rows = rows.withColumn("two", F.coalesce(F.col("b") & (F.col("b_at") <= F.greatest(F.col("limit") - F.col("taken"), F.lit(1))), F.lit(False)))
    done = F.col("one") | F.col("two")
    rows = rows.withColumn("done", done).withColumn("count", F.count_if("done").over(nth("document_id"))).withColumn("all", F.count_if("done").over(nth()))
    rows = rows.withColumn("m", F.when(~F.col("done"), F.count_if(~F.col("done")).over(nth("document_id").orderBy("rank"))))
    rows = rows.withColumn("c", ~F.col("done") & (F.col("m") + F.col("count") <= F.col("cap")))
    rows = rows.withColumn("c_at", F.when(F.col("c"), F.count_if("c").over(nth().orderBy("rank"))))
    rows = rows.withColumn("three", F.coalesce(F.col("c") & (F.col("c_at") <= F.col("limit") - F.col("all")), F.lit(False)))
    place = F.when(F.col("one"), F.col("a")).when(F.col("two"), F.col("taken") + F.col("b_at")).otherwise(F.col("all") + F.col("c_at"))
    return rows.filter("one OR two OR three").select(*ranked.columns, place.alias("place"))


def strict(question: Column, mode: Column) -> Column:
    return (Q.normalize_mode(mode) == "strict") | Q.high_stakes(question, Q.domain(question))


def full_document_score(concepts: Column, chunk: Column, index: Column) -> Column:
    """How well a chunk of a whole document answers: concept terms held, facts, a table, a year, early first."""
    low = F.lower(chunk)
    terms = F.size(F.filter(concepts, lambda t: F.contains(low, t)))
    head = F.substring(chunk, 1, 2500)
    bars = F.length(chunk) - F.length(F.replace(chunk, F.lit("|"), F.lit("")))
    facts = F.least(F.lit(1.0), X.structured_facts(F.substring(chunk, 1, 4000)) / 3)
    return terms + 0.75 * facts + F.when(F.contains(head, F.lit("|")) & (bars >= 4), 0.5).otherwise(0.0) + F.when(low.rlike(r"\b(19|20)[0-9]{2}\b"), 0.25).otherwise(0.0) - index * 0.01


def whole_document_chunks(wanted: DataFrame, docs: DataFrame, questions: DataFrame, chunked: DataFrame) -> DataFrame:
    """The ten best chunks of the whole texts of documents (item_id, document_id), as item_id, document_id, chunk_index, title, doc_type, content, with a line of title, number and date before each."""
    rows = wanted.join(chunked, "document_id").join(questions.select("item_id", Q.concept_terms(F.col("text")).alias("concepts")), "item_id")
    score = F.round(full_document_score(F.col("concepts"), F.col("content"), F.col("chunk_index")), 6)
    order = W.partitionBy("item_id", "document_id").orderBy(F.desc("score"), "chunk_index")
    best = rows.withColumn("score", score).withColumn("n", F.row_number().over(order)).filter("n <= 10").join(docs.select("document_id", "date"), "document_id")
    prefix = F.concat(F.lit("Title: "), "title", F.lit("\nDocument ID: "), F.col("document_id").cast("string"), F.lit("\nDate: "), F.coalesce("date", F.lit("unknown")), F.lit("\n\n"))
    return best.select("item_id", "document_id", (WHOLE + F.col("chunk_index")).cast("int").alias("chunk_index"), "title", "doc_type", F.concat(prefix, "content").alias("content"))


def evidence_rows(ranked: DataFrame, of_sources: DataFrame, chunks: DataFrame, docs: DataFrame, questions: DataFrame, whole: DataFrame, as_of: Column) -> DataFrame:
    """Chunks for a question's evidence by falling score, with their place: the diverse best of a context, their documents' first chunks, and the best of whole documents where much is at stake.

    whole: chunks of whole documents (document_id, chunk_index, title, doc_type, content).
    """
    rules = settled(questions.select("item_id", strict(F.col("text"), F.col("mode")).alias("strict"), (Q.broad(F.col("text")) & (Q.normalize_mode(F.col("mode")) != "quick")).alias("broad")))
    by = lambda a, b: F.when(F.col("strict"), a).otherwise(b)
    chosen = diversified(ranked.withColumn("similarity", F.col("vector_score")).join(rules, "item_id"), F.when(F.col("broad"), 85).otherwise(by(55, 36)), by(4, 3))
    chosen = settled(chosen)
    first = of_sources.join(rules, "item_id").filter(F.col("place") <= by(10, 6)).select("item_id", F.col("place").alias("at"), "document_id")
    then = chosen.filter(F.col("place") <= by(14, 8)).select("item_id", (100 + F.col("place")).alias("at"), "document_id")
    ids = first.unionByName(then).groupBy("item_id", "document_id").agg(F.min("at").alias("at")).join(rules, "item_id")
    ids = ids.withColumn("n", F.row_number().over(W.partitionBy("item_id").orderBy("at"))).filter(F.col("n") <= by(14, 8))
    nth = F.row_number().over(W.partitionBy("document_id").orderBy("chunk_index"))
    beside = ids.join(chunks.withColumn("k", nth).filter("k <= 8"), "document_id").filter(F.col("k") <= by(8, 4))
    columns = ["item_id", "document_id", "chunk_index", "title", "doc_type", "content"]
    some = whole_document_chunks(ids.filter(F.col("strict") & (F.col("n") <= 5)).select("item_id", "document_id"), docs, questions, whole)
    rows = chosen.select(*columns, F.col("combined").alias("score"), F.col("place").cast("long").alias("first"), F.lit(False).alias("whole"))
    rows = rows.unionByName(beside.select(*columns, F.lit(NEIGHBOUR_SCORE).alias("score"), (1_000 + F.col("n") * 100 + F.col("k")).cast("long").alias("first"), F.lit(False).alias("whole")))
    rows = rows.unionByName(some.select(*columns, F.lit(WHOLE_SCORE).alias("score"), (100_000 + F.col("chunk_index")).cast("long").alias("first"), F.lit(True).alias("whole")))
    once = rows.groupBy("item_id", "document_id", "chunk_index").agg(*[F.min_by(c, "first").alias(c) for c in ("title", "doc_type", "content", "whole")], F.max("score").alias("score"), F.min("first").alias("first"))
    again = reranked(once.join(questions.select("item_id", F.col("text").alias("question")), "item_id").withColumn("combined", F.round(VECTOR * F.col("score"), 7)), as_of)
    terms = T.query_terms(F.col("question"))
    held = lambda c: F.size(F.array_intersect(terms, T.signal_terms(c)))
    placed = again.join(of_sources.select("item_id", "document_id", F.col("place").alias("source")), ["item_id", "document_id"], "left")
    source = F.coalesce(F.greatest(F.lit(0.0), SOURCE - SOURCE_STEP * (F.col("source") - 1)), F.lit(0.0))
    score = F.round(F.col("rerank") + TITLE * held(F.col("title")) + CONTENT * held(F.substring("content", 1, 2500)) + source + F.when(F.col("whole"), WHOLE_BOOST).otherwise(0.0), 7)
    order = W.partitionBy("item_id").orderBy(F.desc("score"), "rank")
    placed = settled(placed.withColumn("score", score)).withColumn("place", F.row_number().over(order)).join(rules, "item_id")
    return placed.filter(F.col("place") <= F.when(F.col("broad") | F.col("strict"), 90).otherwise(60)).select(*columns, "question", "score", "place")


def evidence_pack(rows: DataFrame) -> DataFrame:
    """evidence_rows() as evidence items: id, hits, quality, dates and facts of each beside its place."""
    return E.items(rows)


def grades(items: DataFrame, of_sources: DataFrame, questions: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """(item_id, score, level, audit_status) of each question's evidence: its sources, dates, quality, terms, facts and, if given, claims (item_id, a count for each of evidence.STATUSES, status of their verification)."""
    rules = questions.select("item_id", Q.requires_current(F.col("text"), Q.domain(F.col("text")), Q.intent(F.col("text"), Q.normalize_mode(F.col("mode")))).alias("current"))
    dates = F.aggregate(F.map_values("date_signals"), F.lit(0), lambda n, v: n + F.size(v))
    pack = items.groupBy("item_id").agg(F.max("exact_term_hits").alias("hits"), F.sum(dates).alias("signals"), F.round(F.avg("quality_score"), 3).alias("quality"), F.sum("structured_facts").alias("facts"), F.count_if(T.contains_any(F.col("content"), T.SUPERSEDED)).alias("superseded"))
    cited = of_sources.groupBy("item_id").agg(F.count("*").alias("sources"), F.count("date").alias("dated"))
    rows = rules.join(cited, "item_id", "left").join(pack, "item_id", "left").fillna(0, ["sources", "dated", "hits", "signals", "quality", "facts", "superseded"])
    if claims is None:
        rows = rows.withColumns({s: F.lit(0) for s in E.STATUSES}).withColumn("status", F.lit("not_run"))
    else:
        rows = rows.join(claims, "item_id", "left").fillna(0, E.STATUSES)
    c = {n: F.col(n) for n in ("sources", "hits", "dated", "current", "signals", "quality", "superseded", "facts")}
    graded = E.grade(c["sources"], c["hits"], c["dated"], c["current"], c["signals"], c["quality"], c["superseded"], c["facts"], {s: F.col(s) for s in E.STATUSES}, F.col("status"))
    return rows.select("item_id", graded.alias("g")).select("item_id", "g.*")


def source_summary(items: DataFrame, of_sources: DataFrame) -> DataFrame:
    """item_id, source_count, latest_retrieved (date of a source), latest_supporting (of evidence that holds one of the question's rarest terms), latest."""
    found = of_sources.groupBy("item_id").agg(F.count("*").alias("source_count"), F.max("date").alias("latest_retrieved"))
    held = F.array_intersect(T.query_terms(F.col("question")), T.signal_terms(F.concat_ws(" ", "title", "doc_type", "content")))
    rows = items.filter("exact_term_hits > 0").withColumn("held", held)
    terms = rows.select("item_id", F.explode("held").alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("n"))
    n = items.groupBy("item_id").agg(F.least(F.lit(3), F.count("*")).alias("most"))
    rarest = terms.withColumn("least", F.min("n").over(W.partitionBy("item_id"))).join(n, "item_id").filter(F.col("n") <= F.greatest("least", "most")).groupBy("item_id").agg(F.collect_set("term").alias("focus"))
    kinds = F.array(*map(F.lit, ["reported_date", "document_date", "specimen_date", "service_date"]))
    dates = F.flatten(F.transform(kinds, lambda k: F.coalesce(F.element_at("date_signals", k), F.array().cast("array<string>"))))
    supporting = rows.join(rarest, "item_id").filter(F.arrays_overlap("held", "focus")).select("item_id", F.explode(dates).alias("d")).groupBy("item_id").agg(F.max(D.summary_date(F.col("d"))).alias("latest_supporting"))
    return found.join(supporting, "item_id", "left").withColumn("latest", F.coalesce("latest_supporting", "latest_retrieved"))


# ---- the tables at hand ----

#: Characters of a passage, and from one to the next.
PASSAGE, STEP = 1200, 1000
AS_OF = "2024-06-01"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source's documents, dated as the sale of their number."""
    dates = table(spark, sf_dir, "sales").groupBy(F.col("sale_id").alias("document_id")).agg(F.date_format(F.min("sold_at"), "yyyy-MM-dd").alias("date"))
    return source_documents(spark, sf_dir).join(dates, "document_id", "left")


def passages(docs: DataFrame) -> DataFrame:
    """Chunks of a fixed size that overlap, with lines of title, type and date before each."""
    n = F.greatest(F.lit(1), F.ceil((F.length("content") - (PASSAGE - STEP)) / STEP)).cast("int")
    prefix = F.concat(F.lit("Title: "), "title", F.lit("\nDocument type: "), F.coalesce("doc_type", F.lit("")), F.lit("\nDate: "), F.coalesce("date", F.lit("unknown")), F.lit("\n\n"))
    rows = docs.select("document_id", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_index"), "title", "doc_type", prefix.alias("prefix"), "content")
    return rows.select("document_id", "chunk_index", "title", "doc_type", F.concat("prefix", F.substring(F.col("content"), F.col("chunk_index") * STEP + 1, F.lit(PASSAGE))).alias("content"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.lit("Product").alias("label"))


def links(docs: DataFrame) -> DataFrame:
    """Each document with its organisation, the source, and labels of what its text mentions."""
    c = F.col("content")
    rules = [("Person", c.contains("@")), ("FinancialItem", c.rlike("[0-9]{4}[ -][0-9]{4}")), ("Address", c.rlike(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"))]
    return docs.select("document_id", F.col("doc_type").alias("organisation"), F.array_compact(F.array(*[F.when(rule, label) for label, rule in rules])).alias("labels"))


def _all(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Questions, documents, passages and the context of the plans."""
    questions, docs = P._questions(spark, sf_dir), documents(spark, sf_dir)
    chunks = passages(docs)
    return questions, docs, chunks, settled(retrieved(questions, chunks, products(spark, sf_dir), links(docs)))


def retrieve_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged context of every question's plan."""
    return _all(spark, sf_dir)[3]


def merge_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of the first sub-question of each, with those of the others behind it."""
    questions, chunks = P._questions(spark, sf_dir), passages(documents(spark, sf_dir))
    found = searched(subquestions(questions), chunks, products(spark, sf_dir))
    return merge_contexts(merged(found.filter("position = 1")), merged(found.filter("position > 1")))


def build_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions, _, chunks, context = _all(spark, sf_dir)
    found = sources(combined(context, chunks, questions, F.lit(AS_OF).cast("date")))
    return found.select("item_id", "place", "document_id", "chunk_index", "similarity", "title", "doc_type", "date", "excerpt_count", "excerpt")


def _pack(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Evidence items, sources and questions."""
    questions, docs, chunks, context = _all(spark, sf_dir)
    as_of = F.lit(AS_OF).cast("date")
    ranked = settled(combined(context, chunks, questions, as_of))
    cited = settled(sources(ranked))
    return evidence_pack(evidence_rows(ranked, cited, chunks, docs, questions, E.chunk_rows(docs, 3600, 500), as_of)), cited, questions


def evidence_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pack(spark, sf_dir)[0].select("item_id", "place", "document_id", "chunk_index", "id", "score", "exact_term_hits", "quality_score", "quality_tier", "structured_facts")


def question_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of the evidence found for each question, and what its sources' dates are."""
    items, cited, questions = _pack(spark, sf_dir)
    items = settled(items)
    return grades(items, cited, questions).join(source_summary(items, cited), "item_id", "left")


def diversified_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of a question's context that go into its answer: 36 at most, 3 of a document."""
    questions, _, chunks, context = _all(spark, sf_dir)
    ranked = combined(context, chunks, questions, F.lit(AS_OF).cast("date")).withColumn("similarity", F.col("vector_score"))
    return diversified(ranked, F.lit(36), F.lit(3)).select("item_id", "place", "document_id", "chunk_index", "rerank", "graph")


QUERIES = {f.__name__: f for f in (retrieve_plan, merge_context, build_sources, diversified_context, evidence_packs, question_grades)}

_HEAD = f"lower(concat_ws(' ', title, doc_type, substr(content, 1, {B.HEAD})))"


def _sql_search(name: str, rows: str, head: str, cosine: tuple[int, int], keyword: tuple[int, int]) -> str:
    """Common table expressions: the two lists of all sub-questions over a table of document_id, chunk_index and content."""
    vector, words = ("vector", "keyword") if name == "c" else ("entity", "entity_keyword")
    most = lambda both: f"CASE WHEN role IN ('primary', 'current_state') THEN {both[0]} ELSE {both[1]} END"
    return f"""{name}0 AS (SELECT document_id, chunk_index, content, {T.sql_terms(head)} AS terms, {T.sql_trigrams('content')} AS grams FROM {rows}),
{name}t AS (SELECT document_id, chunk_index, len(terms) AS nd, unnest(terms) AS v FROM {name}0), {name}g AS (SELECT document_id, chunk_index, len(grams) AS nd, unnest(grams) AS v FROM {name}0),
{name}v AS (SELECT item_id, position, role, '{vector}' AS list, document_id, chunk_index, round(count(*) / sqrt((nt * nd)::DOUBLE), 6) AS score FROM {name}t JOIN qt USING (v) GROUP BY item_id, position, role, document_id, chunk_index, nt, nd),
{name}s AS (SELECT item_id, position, document_id, chunk_index, round(count(*) / (nq + nd - count(*)), 6) AS similarity FROM {name}g JOIN qg USING (v) GROUP BY item_id, position, document_id, chunk_index, nq, nd),
{name}e AS (SELECT item_id, position, document_id, chunk_index FROM subs, {name}0 WHERE query <> '' AND contains(lower(content), lower(query))),
{name}k AS (SELECT item_id, position, role, '{words}' AS list, document_id, chunk_index, CASE WHEN e.item_id IS NOT NULL THEN 1.0::DOUBLE ELSE similarity END AS score, e.item_id IS NOT NULL AS exact FROM {name}s LEFT JOIN {name}e e USING (item_id, position, document_id, chunk_index) JOIN subs USING (item_id, position) WHERE e.item_id IS NOT NULL OR similarity >= {B.MINIMUM}),
{name}r AS (SELECT item_id, position, list, row_number() OVER (PARTITION BY item_id, position ORDER BY score DESC, document_id, chunk_index) AS ordinal, document_id, chunk_index, score, false AS graph FROM {name}v QUALIFY ordinal <= {most(cosine)}
UNION ALL SELECT item_id, position, list, row_number() OVER (PARTITION BY item_id, position ORDER BY CASE WHEN exact THEN 2 ELSE score END DESC, document_id, chunk_index) AS ordinal, document_id, chunk_index, score, false FROM {name}k QUALIFY ordinal <= {most(keyword)})"""


def _sql_merged(rows: str) -> str:
    return f"SELECT item_id, list, row_number() OVER (PARTITION BY item_id, list ORDER BY position, ordinal) AS ordinal, document_id, chunk_index, score, graph FROM (SELECT * FROM {rows} QUALIFY row_number() OVER (PARTITION BY item_id, list, document_id, chunk_index ORDER BY position, ordinal) = 1)"


_SEARCHED = f"""{P._PLAN}, planned AS (SELECT item_id, text, mode, list_transform(list_filter({P._SUB}, lambda x: x IS NOT NULL)[1:CASE mode WHEN 'quick' THEN 1 WHEN 'strict' THEN 8 ELSE 6 END], lambda x: {{'role': x.role, 'query': trim(x.query)}}) AS s FROM plan),
more AS (SELECT item_id, CASE WHEN mode <> 'quick' AND {T.sql_any('text', Q.SENSITIVE)} AND len(list_filter(s, lambda x: x.role = 'current_state')) = 0 THEN list_append(s, {{'role': 'current_state', 'query': trim(text || '{T.LATEST_SUFFIX}')}}) ELSE s END AS s FROM planned),
subs AS (SELECT item_id, unnest(range(1, len(s) + 1)) AS position, unnest(s).role AS role, unnest(s).query AS query FROM more),
qt AS (SELECT item_id, position, role, len(t) AS nt, unnest(t) AS v FROM (SELECT *, {T.sql_query_terms('query')} AS t FROM subs)), qg AS (SELECT item_id, position, len(g) AS nq, unnest(g) AS v FROM (SELECT *, {T.sql_trigrams('query')} AS g FROM subs)),
dated AS (SELECT sale_id, strftime(min(sold_at), '%Y-%m-%d') AS date FROM sales GROUP BY 1),
docs AS (SELECT doc_id AS document_id, 'Document ' || doc_id AS title, source AS doc_type, coalesce(text, '') AS content, date FROM documents LEFT JOIN dated ON sale_id = doc_id),
cut AS (SELECT *, unnest(range(greatest(1, ceil((length(content) - {PASSAGE - STEP}) / {STEP}.0)::INT))) AS i FROM docs),
chunks AS (SELECT document_id, i::INT AS chunk_index, title, doc_type, 'Title: ' || title || chr(10) || 'Document type: ' || coalesce(doc_type, '') || chr(10) || 'Date: ' || coalesce(date, 'unknown') || chr(10) || chr(10) || substr(content, i * {STEP} + 1, {PASSAGE}) AS content FROM cut),
entities AS (SELECT p_partkey AS document_id, 0::INT AS chunk_index, 'Product ' || p_name AS content FROM part),
{_sql_search('c', 'chunks', _HEAD, LIMITS['vector'], LIMITS['keyword'])},
{_sql_search('n', 'entities', 'lower(content)', LIMITS['entity'], LIMITS['entity_keyword'])},
found AS (SELECT * FROM cr UNION ALL SELECT * FROM nr)"""
_TYPES = f"CASE WHEN {T.sql_any('text', Q.BROAD_WORDS)} AND len(f) < 3 THEN list_distinct(list_concat(f, {P._list(Q.BROAD_TYPES)})) ELSE f END"
_CONTEXT = f"""{_SEARCHED},
asked AS (SELECT item_id, text, {_TYPES} AS types FROM (SELECT item_id, text, {P._FOUND} AS f FROM q WHERE mode <> 'quick' AND {Q.sql_hits('text', Q.BROAD)} >= 1 AND ({T.sql_any('text', Q.SEVERAL)} OR {Q.sql_hits('text', Q.BROAD)} >= 2))),
links AS (SELECT document_id, doc_type AS organisation, list_filter([CASE WHEN contains(content, '@') THEN 'Person' END, CASE WHEN regexp_matches(content, '[0-9]{{4}}[ -][0-9]{{4}}') THEN 'FinancialItem' END, CASE WHEN regexp_matches(content, '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+') THEN 'Address' END], lambda x: x IS NOT NULL) AS labels FROM docs),
latest AS (SELECT document_id, organisation FROM links WHERE organisation IS NOT NULL QUALIFY row_number() OVER (PARTITION BY organisation ORDER BY document_id DESC) <= {PER_ORGANISATION}),
touch AS (SELECT item_id, document_id, organisation, len(list_intersect(types, labels)) AS n FROM asked, links WHERE len(list_intersect(types, labels)) > 0),
ids AS (SELECT item_id, document_id FROM latest JOIN (SELECT DISTINCT item_id, organisation FROM touch UNION SELECT item_id, organisation FROM asked, (SELECT DISTINCT organisation FROM latest) WHERE len(types) = 0) USING (organisation)
UNION SELECT item_id, document_id FROM (SELECT item_id, document_id, n FROM touch QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY n DESC, document_id DESC) <= {BY_TYPE})),
graphed AS (SELECT item_id, 4095 AS position, 'vector' AS list, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, document_id, chunk_index) AS ordinal, document_id, chunk_index, score, true AS graph FROM (SELECT i.item_id, i.document_id, c.chunk_index, round(len(list_intersect(a.t, c.terms)) / sqrt(greatest(1, len(a.t) * len(c.terms))::DOUBLE), 6) AS score FROM ids i JOIN c0 c USING (document_id) JOIN (SELECT item_id, {T.sql_query_terms('text')} AS t FROM asked) a USING (item_id)) ),
everything AS (SELECT * FROM found UNION ALL SELECT g.* FROM graphed g JOIN (SELECT item_id, count(*) AS most FROM ids GROUP BY 1) USING (item_id) WHERE ordinal <= most), context AS ({_sql_merged('everything')})"""
_AGE = f"datediff('day', try_cast(regexp_extract(content, '(?m)^Date:\\s*([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1) AS DATE), DATE '{AS_OF}')"
_BOOST = "CASE " + " ".join(f"WHEN {T.sql_any('question', a)} AND {T.sql_any('doc_type', b)} THEN {x}::DOUBLE" for a, b, x in B.BOOSTS) + " ELSE 0::DOUBLE END"
_RANKED = f"""{_CONTEXT},
scored AS (SELECT item_id, document_id, chunk_index, coalesce(max(score) FILTER (list = 'vector'), 0) AS vector_score, coalesce(max(score) FILTER (list = 'keyword'), 0) AS keyword_score, min(CASE WHEN list = 'vector' THEN ordinal ELSE 1000000 + ordinal END) AS first FROM context WHERE list IN ('vector', 'keyword') GROUP BY 1, 2, 3),
joined AS (SELECT s.*, c.title, c.doc_type, c.content, q.text AS question, round({VECTOR}::DOUBLE * vector_score + {KEYWORD}::DOUBLE * keyword_score, 7) AS combined FROM scored s JOIN chunks c USING (document_id, chunk_index) JOIN q USING (item_id)),
ranked AS (SELECT *, round(combined + {_BOOST} + CASE WHEN {_AGE} <= 90 THEN 0.12::DOUBLE WHEN {_AGE} <= 365 THEN 0.08 WHEN {_AGE} <= 730 THEN 0.04 ELSE 0 END + {B.HIT}::DOUBLE * len(list_intersect({T.sql_query_terms('question')}, {T.sql_terms(_HEAD)})) - CASE WHEN {T.sql_any('content', T.SUPERSEDED)} THEN {B.OLD}::DOUBLE ELSE 0 END, 7) AS rerank, row_number() OVER (PARTITION BY item_id ORDER BY rerank DESC, first, document_id, chunk_index) AS rank FROM joined)"""
_DATE = "trim(regexp_extract(content, '(?m)^Date:\\s*([^\\n]+)', 1))"
ORACLE_SQL = {
    "retrieve_plan": _CONTEXT + " SELECT * FROM context",
    "merge_context": _SEARCHED + f", one AS ({_sql_merged('(SELECT * FROM found WHERE position = 1)')}), other AS ({_sql_merged('(SELECT * FROM found WHERE position > 1)')}), both_ AS (SELECT *, 1 AS position FROM one UNION ALL SELECT *, 2 FROM other) {_sql_merged('both_')}",
    "build_sources": _RANKED
    + f", top AS (SELECT *, row_number() OVER (PARTITION BY item_id, document_id ORDER BY combined DESC, rank) AS n, count(*) OVER (PARTITION BY item_id, document_id) AS excerpt_count, min(rank) OVER (PARTITION BY item_id, document_id) AS came FROM ranked WHERE rank <= {CHUNKS}) SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY combined DESC, came) AS place, document_id, chunk_index, combined AS similarity, title, doc_type, CASE WHEN lower({_DATE}) NOT IN ('', 'unknown') THEN {_DATE} END AS date, excerpt_count, substr(content, 1, {EXCERPT}) AS excerpt FROM top WHERE n = 1 QUALIFY place <= {SOURCES}",
}
