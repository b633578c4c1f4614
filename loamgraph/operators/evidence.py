"""Evidence for questions: items and their rollups, claims, grades, timelines, and chunks chosen for diversity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamgraph.functions import chunks as C
from loamgraph.functions import dates as D
from loamgraph.functions import facts as X
from loamgraph.functions import text as T
from loamgraph.sources.bindings import source_documents, table

#: Added before rounding, so that halves go up whatever the last bit.
HAIR = 1e-9
STATUSES = ["supported", "partial", "unsupported", "conflicting", "unknown"]


def chunk_rows(docs: DataFrame, size: int = C.SIZE, overlap: int = C.OVERLAP) -> DataFrame:
    """document_id, chunk_index, title, doc_type and content of all chunks of documents."""
    return docs.select("document_id", "title", "doc_type", F.posexplode(C.chunked(F.col("content"), size, overlap)).alias("chunk_index", "content")).select("document_id", "chunk_index", "title", "doc_type", "content")


def items(pairs: DataFrame) -> DataFrame:
    """Adds to rows of question, document_id, chunk_index, title, doc_type and content what an evidence item tells of them."""
    quality = X.source_quality(F.col("title"), F.col("doc_type"), F.col("content"))
    hits = F.size(F.array_intersect(T.query_terms(F.col("question")), T.signal_terms(F.concat_ws(" ", "title", "doc_type", "content"))))
    raw = F.concat_ws(":", F.col("document_id").cast("string"), F.col("chunk_index").cast("string"), F.col("title"))
    out = pairs.withColumn("id", F.substring(F.sha1(raw), 1, 10)).withColumn("exact_term_hits", hits).withColumn("q", quality)
    out = out.withColumn("quality_score", F.col("q.score")).withColumn("quality_tier", F.col("q.tier")).drop("q")
    return out.withColumn("date_signals", D.signals(F.col("content"), F.col("title"), D.source_date(F.col("content")))).withColumn("structured_facts", X.structured_facts(F.col("content")))


def documents_of(evidence: DataFrame) -> DataFrame:
    """Items by question and document: chunks, facts, the best quality."""
    best = F.max_by("quality_tier", F.struct("quality_score", -F.col("chunk_index")))
    return evidence.groupBy("item_id", "document_id").agg(F.count("*").alias("chunks"), F.sum("structured_facts").alias("structured_facts"), F.max("quality_score").alias("best_quality"), best.alias("best_tier"))


def coverage(evidence: DataFrame) -> DataFrame:
    """One row for each question: items, documents, direct ones, mean quality, facts and dates."""
    dates = F.aggregate(F.map_values("date_signals"), F.lit(0), lambda n, v: n + F.size(v))
    return evidence.groupBy("item_id").agg(
        F.count("*").alias("items"), F.countDistinct("document_id").alias("documents"), F.count_if(F.col("quality_tier").isin("original", "direct")).alias("direct"),
        F.round(F.avg("quality_score"), 3).alias("mean_quality"), F.sum("structured_facts").alias("structured_facts"), F.sum(dates).alias("dates"),
    )


def focus_terms(matched: DataFrame, n_items: Column) -> DataFrame:
    """Of (item_id, document_id, term) the rarest terms of each question: in as few documents as the rarest of all, or in three."""
    counts = matched.groupBy("item_id", "term").agg(F.countDistinct("document_id").alias("n"))
    least = F.min("n").over(W.partitionBy("item_id"))
    return counts.withColumn("most", F.greatest(least, F.least(F.lit(3), n_items))).filter("n <= most").select("item_id", "term", "n")


def claim_summary(claims: DataFrame) -> DataFrame:
    """One row for each question with the number of claims of every status; others count as unknown."""
    known = F.when(F.col("status").isin(STATUSES), F.col("status")).otherwise("unknown")
    return claims.groupBy("item_id").agg(*[F.count_if(known == s).alias(s) for s in STATUSES])


def repair_queries(claims: DataFrame, limit: int = 5) -> DataFrame:
    """For each question at most so many new queries, from unsupported claims, then conflicting ones, in their order."""
    clean = F.trim(F.substring(F.regexp_replace(F.regexp_replace("claim", "[^A-Za-z0-9 $%./#:-]+", " "), r"\s+", " "), 1, 180))
    kind = F.when(F.col("status") == "unsupported", 0).when(F.col("status") == "conflicting", 1)
    wanted = claims.withColumn("kind", kind).withColumn("clean", clean).filter("kind IS NOT NULL AND clean <> ''")
    ranked = wanted.withColumn("position", F.row_number().over(W.partitionBy("item_id").orderBy("kind", "seq"))).filter(F.col("position") <= limit)
    return ranked.select("item_id", "position", F.concat("question", F.lit(" source evidence "), "clean").alias("query"))


def grade(sources: Column, hits: Column, dated: Column, requires_current: Column, date_signals: Column, quality: Column, superseded: Column, facts: Column, claims: dict[str, Column], status: Column) -> Column:
    """(score, level, audit_status) of an answer from what its evidence covers.

    claims: a count for each of STATUSES; status: of the verification, null if there was none.
    """
    retrieval = F.least(F.lit(1.0), F.when(sources >= 5, 0.75).when(sources >= 2, 0.5).when(sources == 1, 0.28).otherwise(0.0) + F.when(hits >= 3, 0.25).when(hits >= 1, 0.12).otherwise(0.0))
    fresh = F.when(requires_current & (dated == 0), 0.25).otherwise(0.75)
    fresh = F.when(date_signals > 0, F.least(F.lit(1.0), fresh + 0.15)).otherwise(fresh)
    quality = F.when(quality > 0, quality).otherwise(0.45)
    total = claims["supported"] + claims["partial"] + claims["unsupported"] + claims["conflicting"] + claims["unknown"]
    support = F.when(total > 0, (claims["supported"] + 0.5 * claims["partial"]) / total).otherwise(0.5)
    verified = F.coalesce(status.isin("verified", "ok"), F.lit(False))
    clean = verified & (claims["unsupported"] == 0) & (claims["conflicting"] == 0)
    support = F.when(clean, F.greatest(support, F.lit(0.9))).otherwise(support)
    flagged = status.isNotNull() & (claims["unsupported"] > 0)
    support = F.when(flagged, F.least(support, F.greatest(F.lit(0.0), 0.65 - 0.08 * claims["unsupported"]))).otherwise(support)
    against = 1.0 - F.least(F.lit(0.45), 0.12 * superseded)
    stale = status.isNotNull() & (claims["conflicting"] > 0)
    against = F.when(stale, F.least(against, F.greatest(F.lit(0.0), 0.8 - 0.1 * claims["conflicting"]))).otherwise(against)
    structured = F.when(facts >= 20, 1.0).when(facts >= 5, 0.7).otherwise(0.35)
    cap = F.when(status == "checking", 0.69).when(status == "not_run", 0.74).when(status == "needs_review", 0.77).when(verified | (total > 0), 1.0).otherwise(0.74)
    score = 0.22 * retrieval + 0.18 * fresh + 0.3 * support + 0.15 * quality + 0.1 * F.greatest(F.lit(0.0), against) + 0.05 * structured
    score = F.round(F.least(cap, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))), 6)
    audit = F.when(status == "checking", "checking").when(status == "not_run", "verifier_unavailable").when(status == "needs_review", "needs_review")
    audit = audit.when(verified & (total == 0), "verifier_checked").when(total > 0, "claim_audited").otherwise("audit_missing")
    return F.struct(F.round(score + HAIR, 3).alias("score"), F.when(score >= 0.78, "high").when(score >= 0.5, "medium").otherwise("low").alias("level"), audit.alias("audit_status"))


def blended(model: Column, evidence: Column, adjustment: Column, status: Column) -> Column:
    """Confidence from the model's and the evidence's, capped while claims are unchecked."""
    x = 0.35 * F.coalesce(F.when(model != 0, model), F.lit(0.5)) + 0.65 * evidence + F.coalesce(adjustment, F.lit(0.0))
    x = F.when(status == "checking", F.least(x, F.lit(0.69))).when(status == "not_run", F.least(x, F.lit(0.74))).otherwise(x)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) + HAIR, 3)


def diversified(ranked: DataFrame, limit: int = 40, per_document: int = 2) -> DataFrame:
    """Of (item_id, position, document_id, graph, similarity) rows at most ``limit`` of each question, at most ``per_document`` of a document, with their place.

    Half of them are the best that do not come from the graph; then come rows from the graph of
    documents not seen yet; then the best of what is left.
    """

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position", kind="stable")
        taken: list[int] = []
        count: dict[int, int] = {}

        def take(some: Iterator[tuple[int, int]], most: int, fresh: bool) -> None:
            for i, d in some:
                if len(taken) >= most:
                    return
                if i not in picked and count.get(d, 0) < per_document and not (fresh and d in count):
                    picked.add(i)
                    taken.append(i)
                    count[d] = count.get(d, 0) + 1

        picked: set[int] = set()
        pairs = lambda x: zip(x.index.tolist(), x.document_id.tolist())
        take(pairs(rows[~rows.graph]), max(1, limit // 2), False)
        take(pairs(rows[rows.graph].sort_values("similarity", ascending=False, kind="stable")), limit, True)
        take(pairs(rows), limit, False)
        out = rows.loc[taken, ["item_id", "position", "document_id"]]
        return out.assign(place=range(1, len(out) + 1))

    # Of a question no more rows can be chosen than the best of each of its documents.
    best = F.row_number().over(W.partitionBy("item_id", "document_id").orderBy("position"))
    few = ranked.withColumn("n", best).filter(F.col("n") <= 2 * per_document).drop("n")
    last = F.row_number().over(W.partitionBy("item_id", "graph").orderBy("position"))
    few = few.withColumn("n", last).filter(F.col("n") <= 4 * limit * per_document).drop("n")
    return few.groupBy("item_id").applyInPandas(choose, "item_id long, position long, document_id long, place long")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("question"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document under one question, by their numbers."""
    questions = _questions(spark, sf_dir)
    n = questions.agg(F.count("*").alias("n"))
    return source_documents(spark, sf_dir).crossJoin(n).withColumn("item_id", F.col("document_id") % F.col("n")).drop("n").join(questions, "item_id")  # one row


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_rows(source_documents(spark, sf_dir)).select("document_id", "chunk_index", "content")


def structured_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("content")
    return source_documents(spark, sf_dir).select("document_id", X.table_rows(c).alias("table_rows"), X.count(c, X.NUMERIC).alias("numeric"), X.count(c, X.IDENTIFIER).alias("identifiers"), X.count(c, X.LABELLED).alias("labelled"), X.structured_facts(c).alias("facts"))


def evidence_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = items(_pairs(spark, sf_dir).withColumn("chunk_index", F.lit(0)))
    return found.select("item_id", "document_id", "id", "exact_term_hits", "quality_score", "quality_tier", "structured_facts", F.to_json("date_signals").alias("dates"))


def evidence_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunk_rows(source_documents(spark, sf_dir)).join(_pairs(spark, sf_dir).select("document_id", "item_id", "question"), "document_id")
    return documents_of(items(chunks))


def evidence_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage(items(_pairs(spark, sf_dir).withColumn("chunk_index", F.lit(0))))


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.array_intersect(T.query_terms(F.col("question")), T.signal_terms(F.col("content")))
    return _pairs(spark, sf_dir).select("item_id", "document_id", F.explode(terms).alias("term"))


def evidence_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many terms of its question each document holds."""
    return _matched(spark, sf_dir).groupBy("item_id", "document_id").agg(F.count("*").alias("hits"))


def evidence_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return focus_terms(_matched(spark, sf_dir), F.lit(3))


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as claims: conversation, turn, text, and a status by their numbers."""
    status = F.element_at(F.array(*map(F.lit, [*STATUSES, "other"])), ((F.col("conv_id") + F.col("turn")) % 6 + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("item_id"), F.col("turn").alias("seq"), F.coalesce("text", F.lit("")).alias("claim"), status.alias("status"), F.lit("question").alias("question"))


def claim_ledger_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claim_summary(_claims(spark, sf_dir))


def repair_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_queries(_claims(spark, sf_dir))


_VERIFIED = ["verified", "checking", "not_run", "needs_review", None]


def evidence_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of conversations: their claims, and numbers of sources, hits, dates and facts by their numbers."""
    k = F.col("item_id")
    status = F.element_at(F.array(*[F.lit(v) for v in _VERIFIED]), (k % 5 + 1).cast("int"))
    of = grade(k % 7, k % 4, k % 2, k % 3 == 0, k % 5, (k % 11) / 10, k % 4, (k * 3) % 31, {s: F.col(s) for s in STATUSES}, status)
    return claim_ledger_summary(spark, sf_dir).select("item_id", of.alias("g")).select("item_id", "g.*")


def blend_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("item_id")
    status = F.element_at(F.array(*[F.lit(v) for v in _VERIFIED]), (k % 5 + 1).cast("int"))
    return evidence_grade(spark, sf_dir).select("item_id", blended((k % 10) / 10, F.col("score"), (k % 3 - 1) / 20, status).alias("confidence"))


def current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer whether a current state is needed and known: the date of the latest order, and how many are dated or closed."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 4 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"), (F.col("o_orderstatus") == "F").alias("closed"))
    out = o.groupBy("o_custkey").agg(F.max("date").alias("latest"), F.count("date").alias("dated"), F.count_if("closed").alias("superseded"))
    status = F.when(F.col("latest").isNotNull(), "resolved").when(F.col("o_custkey") % 2 == 1, "needs_review").otherwise("not_required")
    return out.withColumn("status", status)


def diversify_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the documents under each question, in the order of a hash."""
    chunks = chunk_rows(source_documents(spark, sf_dir)).select("document_id", "chunk_index").join(_pairs(spark, sf_dir).select("document_id", "item_id"), "document_id")
    order = F.row_number().over(W.partitionBy("item_id").orderBy(F.xxhash64("document_id", "chunk_index"), "document_id", "chunk_index"))
    return diversified(chunks.withColumn("position", order.cast("long")).withColumn("graph", F.col("document_id") % 3 == 0).withColumn("similarity", F.lit(1.0) / F.col("position")))


QUERIES = {
    f.__name__: f
    for f in (
        chunk_documents, structured_facts, evidence_items, evidence_documents, evidence_coverage, evidence_hits, evidence_focus, claim_ledger_summary, repair_questions,
        evidence_grade, blend_confidence, current_state, diversify_chunks,
    )
}
_MATCHED = f"WITH p AS (SELECT b.item_id, d.doc_id AS document_id, b.text AS question, coalesce(d.text, '') AS content FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)), m AS (SELECT item_id, document_id, unnest(list_intersect({T.sql_query_terms('question')}, {T.sql_terms('content')})) AS term FROM p)"
_CLAIMS = "WITH c AS (SELECT conv_id AS item_id, turn AS seq, coalesce(text, '') AS claim, ['supported', 'partial', 'unsupported', 'conflicting', 'unknown', 'other'][(conv_id + turn) % 6 + 1] AS status FROM conversations)"
_SUMMARY = _CLAIMS + ", s AS (SELECT item_id, " + ", ".join(f"count_if(status = '{s}')::BIGINT AS {s}" for s in STATUSES[:4]) + ", count_if(status IN ('unknown', 'other')) AS unknown FROM c GROUP BY 1)"
_GRADE = (
    _SUMMARY
    + """, a AS (SELECT *, item_id AS k, ['verified', 'checking', 'not_run', 'needs_review', NULL][item_id % 5 + 1] AS st, supported + partial + unsupported + conflicting + unknown AS total FROM s),
b AS (SELECT *, least(1.0::DOUBLE, CASE WHEN k % 7 >= 5 THEN 0.75::DOUBLE WHEN k % 7 >= 2 THEN 0.5 WHEN k % 7 = 1 THEN 0.28 ELSE 0 END + CASE WHEN k % 4 >= 3 THEN 0.25::DOUBLE WHEN k % 4 >= 1 THEN 0.12 ELSE 0 END) AS retrieval,
CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN 0.25::DOUBLE ELSE 0.75 END AS fresh0, CASE WHEN k % 11 > 0 THEN (k % 11) / 10::DOUBLE ELSE 0.45 END AS quality,
CASE WHEN total > 0 THEN (supported + 0.5::DOUBLE * partial) / total ELSE 0.5::DOUBLE END AS support0, 1 - least(0.45::DOUBLE, 0.12::DOUBLE * (k % 4)) AS against0, CASE WHEN (k * 3) % 31 >= 20 THEN 1.0::DOUBLE WHEN (k * 3) % 31 >= 5 THEN 0.7 ELSE 0.35 END AS structured,
CASE WHEN st = 'checking' THEN 0.69::DOUBLE WHEN st = 'not_run' THEN 0.74 WHEN st = 'needs_review' THEN 0.77 WHEN st = 'verified' OR total > 0 THEN 1.0 ELSE 0.74 END AS cap FROM a),
c2 AS (SELECT *, CASE WHEN k % 5 > 0 THEN least(1.0::DOUBLE, fresh0 + 0.15) ELSE fresh0 END AS fresh,
CASE WHEN st IS NOT NULL AND unsupported > 0 THEN least(support0, greatest(0::DOUBLE, 0.65 - 0.08 * unsupported)) WHEN st = 'verified' AND conflicting = 0 THEN greatest(support0, 0.9::DOUBLE) ELSE support0 END AS support,
CASE WHEN st IS NOT NULL AND conflicting > 0 THEN least(against0, greatest(0::DOUBLE, 0.8 - 0.1 * conflicting)) ELSE against0 END AS against FROM b),
g AS (SELECT *, round(least(cap, greatest(0::DOUBLE, least(1::DOUBLE, 0.22::DOUBLE * retrieval + 0.18::DOUBLE * fresh + 0.3::DOUBLE * support + 0.15::DOUBLE * quality + 0.1::DOUBLE * greatest(0::DOUBLE, against) + 0.05::DOUBLE * structured))), 6) AS x FROM c2)
"""
)
ORACLE_SQL = {
    "evidence_hits": _MATCHED + " SELECT item_id, document_id, count(*) AS hits FROM m GROUP BY 1, 2",
    "evidence_focus": _MATCHED + ", n AS (SELECT item_id, term, count(DISTINCT document_id) AS n FROM m GROUP BY 1, 2) SELECT * FROM n QUALIFY n <= greatest(min(n) OVER (PARTITION BY item_id), 3)",
    "claim_ledger_summary": _SUMMARY + " SELECT * FROM s",
    "repair_questions": _CLAIMS + r", r AS (SELECT item_id, seq, status, trim(substr(regexp_replace(regexp_replace(claim, '[^A-Za-z0-9 $%./#:-]+', ' ', 'g'), '\s+', ' ', 'g'), 1, 180)) AS clean FROM c WHERE status IN ('unsupported', 'conflicting')) SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY status = 'conflicting', seq) AS position, 'question source evidence ' || clean AS query FROM r WHERE clean <> '' QUALIFY position <= 5",
    "evidence_grade": _GRADE + " SELECT item_id, round(x + 1e-9, 3) AS score, CASE WHEN x >= 0.78 THEN 'high' WHEN x >= 0.5 THEN 'medium' ELSE 'low' END AS level, CASE WHEN st = 'checking' THEN 'checking' WHEN st = 'not_run' THEN 'verifier_unavailable' WHEN st = 'needs_review' THEN 'needs_review' WHEN total > 0 THEN 'claim_audited' WHEN st = 'verified' THEN 'verifier_checked' ELSE 'audit_missing' END AS audit_status FROM g",
    "blend_confidence": _GRADE + ", y AS (SELECT item_id, st, 0.35::DOUBLE * CASE WHEN k % 10 = 0 THEN 0.5::DOUBLE ELSE (k % 10) / 10::DOUBLE END + 0.65::DOUBLE * round(x + 1e-9, 3) + (k % 3 - 1) / 20::DOUBLE AS z FROM g) SELECT item_id, round(greatest(0::DOUBLE, least(1::DOUBLE, CASE WHEN st = 'checking' THEN least(z, 0.69::DOUBLE) WHEN st = 'not_run' THEN least(z, 0.74::DOUBLE) ELSE z END)) + 1e-9, 3) AS confidence FROM y",
    "current_state": "WITH o AS (SELECT o_custkey, CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date, o_orderstatus = 'F' AS closed FROM orders) SELECT o_custkey, max(date) AS latest, count(date) AS dated, count_if(closed) AS superseded, CASE WHEN max(date) IS NOT NULL THEN 'resolved' WHEN o_custkey % 2 = 1 THEN 'needs_review' ELSE 'not_required' END AS status FROM o GROUP BY 1",
}
