"""Reads of the source, states of documents and runs, suggestions and decisions, scores of evaluation cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamgraph.operators import archive, graph
from loamgraph.sources.bindings import SQL, assertions, nodes, source_documents, table

PAGE_SIZE = 50
#: What marks a model of embeddings by its name (fixed values).
EMBEDDING_MARKS = ["embed", "embedding", "titan-embed"]
#: A last run longer ago than so many hours is stale.
STALE_HOURS = 24.0


def page(rows: DataFrame, order: list[str], number: int, size: int = PAGE_SIZE) -> DataFrame:
    """One page, from 1, of rows in this order, which must be total for pages to be stable."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def summary(docs: DataFrame, order: str) -> DataFrame:
    """One row: how many documents there are, and id and title of the latest; of equally late ones the largest id."""
    latest = F.max(F.struct(F.col(order).alias("at"), "document_id", "title"))
    return docs.agg(F.count("*").alias("documents"), latest.alias("m")).select("documents", F.col("m.document_id").alias("latest_id"), F.col("m.title").alias("latest_title"))


def tag_ids(wanted: DataFrame, tags: DataFrame) -> DataFrame:
    """(wanted, tag_id): tags whose name or slug is the wanted one whatever its case; a null tag_id where none is."""
    key = F.lower(F.trim("wanted"))
    named = tags.select(F.explode(F.array_distinct(F.array(F.lower(F.trim("name")), F.lower(F.trim("slug"))))).alias("key"), "tag_id").distinct()
    return wanted.withColumn("key", key).join(named, "key", "left").select("wanted", "tag_id")


def document_states(docs: DataFrame, hashes: DataFrame, chunks: DataFrame, feedback: DataFrame) -> DataFrame:
    """Of each document its stored hash, its chunks and what was said about it; each side is grouped before it is joined."""
    n_chunks = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"))
    n_feedback = feedback.groupBy("document_id").agg(F.count("*").alias("feedback"))
    stored = hashes.select("document_id", "content_hash").withColumn("hashed", F.lit(True))
    out = docs.select("document_id").join(stored, "document_id", "left").join(n_chunks, "document_id", "left").join(n_feedback, "document_id", "left")
    return out.select("document_id", F.coalesce("hashed", F.lit(False)).alias("hashed"), F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("feedback", F.lit(0)).alias("feedback"))


def sorted_pair(df: DataFrame, a: str, b: str) -> DataFrame:
    """The pair as (a, b) with a <= b."""
    return df.withColumns({"__a": F.least(a, b), "__b": F.greatest(a, b)}).drop(a, b).withColumnsRenamed({"__a": a, "__b": b})


def latest_of_pair(suggestions: DataFrame) -> DataFrame:
    """Of suggestions (a, b, created_at, ...) on a pair, whichever way round, the latest."""
    rest = [c for c in suggestions.columns if c not in ("a", "b", "created_at")]
    last = sorted_pair(suggestions, "a", "b").groupBy("a", "b").agg(F.max(F.struct("created_at", *rest)).alias("m"))
    return last.select("a", "b", "m.*")


def selectable_models(models: DataFrame) -> DataFrame:
    """(position, id) of the models (n, id, mode) that are none of embeddings, each id once, by name whatever its case."""
    marked = F.exists(F.array(*map(F.lit, EMBEDDING_MARKS)), lambda m: F.contains(F.lower("id"), m))
    of_embeddings = F.lower(F.coalesce("mode", F.lit(""))).isin("embedding", "embeddings") | marked
    ids = models.filter((F.col("id") != "") & ~of_embeddings).select("id").distinct()
    return ids.select(F.row_number().over(W.orderBy(F.lower("id"), "id")).alias("position"), "id")


def score_cases(cases: DataFrame, min_confidence: float = 0.35) -> DataFrame:
    """Cases (id, answer, required_terms, required_docs, docs, confidence, trust, min_trust) with what the answer lacks and whether it passes; null lists are empty, null numbers zero."""
    none = lambda c: F.coalesce(c, F.array())
    answer = F.lower(F.coalesce("answer", F.lit("")))
    missing_terms = F.filter(none(F.col("required_terms")), lambda t: ~F.contains(answer, F.lower(t)))
    missing_docs = F.array_sort(F.array_except(none(F.col("required_docs")), none(F.col("docs"))))
    out = cases.select("id", missing_terms.alias("missing_terms"), missing_docs.alias("missing_docs"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("min_trust", F.lit(0.0)).alias("least"))
    passed = (F.size("missing_terms") == 0) & (F.size("missing_docs") == 0) & (F.col("confidence") >= min_confidence) & (F.col("trust") >= F.col("least"))
    return out.select("id", "missing_terms", "missing_docs", passed.alias("passed"))


def hours_between(earlier: Column, later: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(3.6e9)


def source_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of the documents behind id 100."""
    docs = source_documents(spark, sf_dir).filter("document_id > 100").select("document_id", "title", "doc_type")
    return page(docs, ["document_id"], 2)


def source_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_documents(spark, sf_dir).filter("document_id = 7")


def source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(source_documents(spark, sf_dir), "document_id")


def skip_tag_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as tags, one found by its name, one by its slug, one not at all."""
    tags = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("tag_id"), F.col("n_name").alias("name"), F.replace("n_name", F.lit("_"), F.lit("-")).alias("slug"))
    wanted = spark.sql("SELECT * FROM VALUES (' nation_1 '), ('Nation-2'), ('no such tag') AS t(wanted)")
    return tag_ids(wanted, tags)


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), "text")


def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).agg(F.count("*").alias("chunks"), F.countDistinct("document_id").alias("documents"))


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first chunks of one document, with the constant similarity of that read."""
    return _chunks(spark, sf_dir).filter("document_id = 3").orderBy("chunk_index").limit(3).select("document_id", "chunk_index", "text", F.lit(0.5).alias("similarity"))


def document_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    feedback = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("document_id"))
    return document_states(source_documents(spark, sf_dir), archive.stored_hashes(spark, sf_dir), _chunks(spark, sf_dir), feedback)


def composite_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: counts of the graph and of chunks, the last run, lines of errors and whether anything drifted."""
    run = archive._logs(spark, sf_dir).agg(F.max("event_id").alias("last_run"), F.count_if(F.col("level") == "ERROR").alias("errors"))
    stale = archive._drift(spark, sf_dir).agg((F.count("*") > 0).alias("stale"))
    counts = chunk_counts(spark, sf_dir).withColumnRenamed("documents", "chunked_documents")
    return graph.graph_counts(spark, sf_dir).crossJoin(counts).crossJoin(run).crossJoin(stale)  # rows of one


def drift_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What drifted, with how many ids and up to ten of them; categories without any have no row."""
    drifted = archive._drift(spark, sf_dir).withColumn("n", F.row_number().over(W.partitionBy("store", "kind").orderBy("document_id")))
    first = F.array_join(F.array_sort(F.collect_list(F.when(F.col("n") <= 10, F.col("document_id")))), ",")
    return drifted.groupBy("store", "kind").agg(F.count("*").alias("ids"), first.alias("first_ids"))


def sync_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: hours between the last sign-up, which stands for a run, and the last event, and the alert that follows."""
    run = F.max(F.when(F.col("event_type") == "signup", F.col("ts")))
    age = table(spark, sf_dir, "events").agg(hours_between(run, F.max("ts")).alias("age_hours"))
    alert = F.when(F.col("age_hours").isNull(), "sync_never_ran").when(F.col("age_hours") > STALE_HOURS, "sync_stale").otherwise("none")
    return age.select(F.round("age_hours", 3).alias("age_hours"), alert.alias("alert"))


def cache_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, misses and hit rate of each user, clicks being hits and views misses; 0 without either."""
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("hits"), F.count_if(F.col("event_type") == "view").alias("misses"))
    return counts.withColumn("hit_rate", F.round(F.coalesce(F.try_divide("hits", F.col("hits") + F.col("misses")), F.lit(0.0)), 3))


def recent_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten latest lines of each level."""
    latest = F.row_number().over(W.partitionBy("level").orderBy(F.desc("ts"), F.desc("event_id")))
    return archive._logs(spark, sf_dir).withColumn("position", latest).filter("position <= 10").select("level", "position", "event_id")


def _suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("user_id") % 25).alias("a"), (F.col("event_id") % 25).alias("b"), F.col("event_id").alias("created_at"), F.col("event_type").alias("decision")).filter("a <> b")


def pair_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on pairs, sorted, a later one in place of the one before."""
    return latest_of_pair(_suggestions(spark, sf_dir))


def candidate_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of one region as candidate pairs, with the latest suggestion if there is one."""
    n = table(spark, sf_dir, "nation")
    left, right = n.select(F.col("n_nationkey").cast("long").alias("a"), "n_regionkey"), n.select(F.col("n_nationkey").cast("long").alias("b"), "n_regionkey")
    pairs = left.join(right, "n_regionkey").filter("a < b").select("a", "b")
    return pairs.join(latest_of_pair(_suggestions(spark, sf_dir).filter("created_at % 3 = 0")), ["a", "b"], "left")


def conversation_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that stay once the conversations without an answer of more than 300 characters are deleted, by conversation."""
    messages = table(spark, sf_dir, "conversations")
    kept = messages.filter("role = 'assistant' AND length(text) > 300").select("conv_id").distinct()
    return messages.join(kept, "conv_id", "left_semi").groupBy("conv_id").agg(F.count("*").alias("messages"))


def doc_type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_documents(spark, sf_dir).groupBy("doc_type").agg(F.count("*").alias("documents"))


def model_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as models, those of one type as models of embeddings."""
    models = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"), F.concat_ws("/", "p_type", "p_brand").alias("id"), F.when(F.col("p_type") == "ECONOMY", "Embedding").alias("mode"))
    return selectable_models(models)


def one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation and what it has an edge with."""
    seeds = nodes(spark, sf_dir).filter("id = 'N-3'")
    return graph.neighbours(assertions(spark, sf_dir), seeds, 1)


def initial_graph_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the fifty nodes of each label with most edges the hundred with most, ties to the smaller id."""
    return graph.graph_initial_sample(spark, sf_dir).orderBy(F.desc("degree"), "id").limit(100).select("id", "label", "degree")


def org_document_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of organisations, the latest first, each numbered within its organisation."""
    docs = graph.edges(assertions(spark, sf_dir)).filter("rel_type = 'PROVIDER_FOR'")
    return docs.select(F.col("dst").alias("org"), F.col("src").alias("doc_id"), F.row_number().over(W.partitionBy("dst").orderBy(F.desc("last_doc"), "src")).alias("rank"))


def eval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as cases, the document of the same number as answer: the first three terms and two documents are required."""
    words = lambda x: F.regexp_extract_all(F.lower(x), F.lit("[a-z]+"), F.lit(0))
    item = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.slice(words(F.col("text")), 1, 3).alias("required_terms"))
    answer = source_documents(spark, sf_dir).select(F.col("document_id").alias("id"), F.col("content").alias("answer"), (F.length("content") % 100 / 100).alias("confidence"))
    cases = item.join(answer, "id", "left").withColumns({"required_docs": F.array("id", F.col("id") % 7), "docs": F.array(F.col("id"), F.col("id") % 5), "trust": F.col("id") % 10 / 10, "min_trust": F.lit(0.2)})
    return score_cases(cases).select("id", F.array_join("missing_terms", ",").alias("missing_terms"), F.array_join("missing_docs", ",").alias("missing_docs"), "passed")


def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eval_scores(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


QUERIES = {
    f.__name__: f
    for f in (
        source_page, source_document, source_summary, skip_tag_ids, chunk_counts, document_chunks, document_status, composite_status, drift_categories, sync_age, cache_metrics, recent_results,
        pair_decisions, candidate_suggestions, conversation_delete, doc_type_histogram, model_list, one_hop, initial_graph_limited, org_document_ranks, eval_scores, eval_summary,
    )
}
_PAIRS = "(SELECT least(user_id % 25, event_id % 25) AS a, greatest(user_id % 25, event_id % 25) AS b, event_id AS created_at, event_type AS decision FROM events WHERE user_id % 25 <> event_id % 25)"
_LAST = "QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY created_at DESC) = 1"
_EVAL = """WITH c AS (SELECT b.item_id AS id, regexp_extract_all(lower(b.text), '[a-z]+')[1:3] AS terms, lower(coalesce(d.text, '')) AS answer, coalesce(length(coalesce(d.text, '')) % 100 / 100.0, 0) AS confidence, d.doc_id
FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id),
s AS (SELECT id, array_to_string(list_filter(terms, lambda t: NOT contains(answer, t)), ',') AS missing_terms, CASE WHEN id % 7 IN (id, id % 5) THEN '' ELSE (id % 7)::VARCHAR END AS missing_docs,
CASE WHEN doc_id IS NULL THEN 0 ELSE confidence END AS confidence FROM c),
r AS (SELECT id, missing_terms, missing_docs, missing_terms = '' AND missing_docs = '' AND confidence >= 0.35 AND id % 10 >= 2 AS passed FROM s)"""
_ALERT = f"CASE WHEN age IS NULL THEN 'sync_never_ran' WHEN age > {STALE_HOURS} THEN 'sync_stale' ELSE 'none' END"
ORACLE_SQL = {
    "source_page": "SELECT doc_id AS document_id, 'Document ' || doc_id AS title, source AS doc_type FROM documents WHERE doc_id > 100 ORDER BY 1 LIMIT 50 OFFSET 50",
    "source_document": "SELECT doc_id AS document_id, 'Document ' || doc_id AS title, coalesce(text, '') AS content, source AS doc_type, sha256(coalesce(text, '')) AS content_hash FROM documents WHERE doc_id = 7",
    "source_summary": "SELECT count(*) AS documents, max(doc_id) AS latest_id, 'Document ' || max(doc_id) AS latest_title FROM documents",
    "skip_tag_ids": "SELECT wanted, n_nationkey AS tag_id FROM (VALUES (' nation_1 '), ('Nation-2'), ('no such tag')) t(wanted) LEFT JOIN nation ON lower(trim(wanted)) IN (lower(n_name), lower(replace(n_name, '_', '-')))",
    "chunk_counts": "SELECT count(*) AS chunks, count(DISTINCT conv_id) AS documents FROM conversations",
    "document_chunks": "SELECT conv_id AS document_id, turn AS chunk_index, text, 0.5::DOUBLE AS similarity FROM conversations WHERE conv_id = 3 ORDER BY turn LIMIT 3",
    "document_status": "SELECT doc_id AS document_id, doc_id % 11 <> 0 AS hashed, (SELECT count(*) FROM conversations WHERE conv_id = d.doc_id) AS chunks, (SELECT count(*) FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1) AS feedback FROM documents d",
    "composite_status": SQL + ", " + archive._DRIFT.removeprefix("WITH ") + " SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS relationships, (SELECT count(*) FROM nodes WHERE label = 'Document') AS documents, (SELECT count(*) FROM nodes WHERE label <> 'Document') AS entities, (SELECT count(*) FROM conversations) AS chunks, (SELECT count(DISTINCT conv_id) FROM conversations) AS chunked_documents, (SELECT max(event_id) FROM events) AS last_run, (SELECT count(*) FROM events WHERE event_type = 'error') AS errors, (SELECT count(*) > 0 FROM drift) AS stale",
    "drift_categories": archive._DRIFT + " SELECT store, kind, count(*) AS ids, array_to_string(list_sort(list(doc_id))[1:10], ',') AS first_ids FROM drift GROUP BY 1, 2",
    "sync_age": f"SELECT round(age, 3) AS age_hours, {_ALERT} AS alert FROM (SELECT (epoch_us(max(ts)) - epoch_us(max(ts) FILTER (event_type = 'signup'))) / 3.6e9 AS age FROM events)",
    "cache_metrics": "SELECT user_id, count_if(event_type = 'click') AS hits, count_if(event_type = 'view') AS misses, round(coalesce(hits / nullif(hits + misses, 0), 0), 3) AS hit_rate FROM events GROUP BY 1",
    "recent_results": f"SELECT {archive._LEVEL} AS level, row_number() OVER (PARTITION BY {archive._LEVEL} ORDER BY ts DESC, event_id DESC) AS position, event_id FROM events QUALIFY position <= 10",
    "pair_decisions": f"SELECT a, b, created_at, decision FROM {_PAIRS} {_LAST}",
    "candidate_suggestions": f"SELECT p.a, p.b, s.created_at, s.decision FROM (SELECT x.n_nationkey AS a, y.n_nationkey AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey) p LEFT JOIN (SELECT * FROM {_PAIRS} WHERE created_at % 3 = 0 {_LAST}) s ON p.a = s.a AND p.b = s.b",
    "conversation_delete": "SELECT conv_id, count(*) AS messages FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'assistant' AND length(text) > 300) GROUP BY 1",
    "doc_type_histogram": "SELECT source AS doc_type, count(*) AS documents FROM documents GROUP BY 1",
    "model_list": "SELECT row_number() OVER (ORDER BY lower(id), id) AS position, id FROM (SELECT DISTINCT concat_ws('/', p_type, p_brand) AS id FROM part WHERE p_type IS DISTINCT FROM 'ECONOMY') WHERE id <> '' AND NOT contains(lower(id), 'embed')",
    "one_hop": SQL + "SELECT id, min(d) AS distance FROM (SELECT 'N-3' AS id, 0 AS d UNION ALL SELECT dst, 1 FROM edges WHERE src = 'N-3' UNION ALL SELECT src, 1 FROM edges WHERE dst = 'N-3') GROUP BY 1",
    "initial_graph_limited": SQL + graph._DEGREE + " SELECT id, label, degree FROM (SELECT * FROM degree QUALIFY row_number() OVER (PARTITION BY label ORDER BY degree DESC, id) <= 50) ORDER BY degree DESC, id LIMIT 100",
    "org_document_ranks": SQL + "SELECT dst AS org, src AS doc_id, row_number() OVER (PARTITION BY dst ORDER BY last_doc DESC, src) AS rank FROM edges WHERE rel_type = 'PROVIDER_FOR'",
    "eval_scores": _EVAL + " SELECT * FROM r",
    "eval_summary": _EVAL + " SELECT count(*) AS total, count_if(passed) AS passed, count_if(NOT passed) AS failed FROM r",
}
