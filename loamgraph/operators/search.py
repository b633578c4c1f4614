"""Search and ranking: exact vector top-k, literal and trigram keywords, and the hybrid of terms and trigrams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamgraph.functions import text as T
from loamgraph.operators import blocksearch as B
from loamgraph.operators.blocksearch import BOOSTS, HEAD, MINIMUM
from loamgraph.sources.bindings import source_documents, table


def keyword_search(questions: DataFrame, docs: DataFrame, limit: int) -> DataFrame:
    """For each question at most ``limit`` documents: those that hold it literally (1.0), then by trigram similarity of at least MINIMUM; ties by id."""
    found = B.search(questions.withColumnRenamed("item_id", "qid"), docs.withColumn("chunk_index", F.lit(0)), {"keyword": limit})
    return found.select(F.col("qid").alias("item_id"), "document_id", F.when(F.col("exact"), 1.0).otherwise(F.col("similarity")).alias("rank_score"), "rank")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("text"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source's documents, dealt out by id where the files come in fewer splits than there are cores."""
    docs, cores = source_documents(spark, sf_dir), spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores, "document_id")


def merge_ranked(vector: DataFrame, keyword: DataFrame) -> DataFrame:
    """One row for each (item_id, document_id) of either side with vector_score, keyword_score and combined."""
    v = vector.groupBy("item_id", "document_id").agg(F.max("similarity").alias("vector_score"))
    k = keyword.groupBy("item_id", "document_id").agg(F.max("rank_score").alias("keyword_score"))
    out = v.join(k, ["item_id", "document_id"], "full").fillna(0.0, ["vector_score", "keyword_score"])
    return out.withColumn("combined", F.round(0.7 * F.col("vector_score") + 0.3 * F.col("keyword_score"), 7))


def hybrid_rank_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each question the five best of all documents similar to it."""
    found = B.search(_questions(spark, sf_dir).withColumnRenamed("item_id", "qid"), _documents(spark, sf_dir).withColumn("chunk_index", F.lit(0)), {"hybrid": 5})
    score = F.round((F.col("key") - 10**7) / 10**7, 7)
    return found.select(F.col("qid").alias("item_id"), "document_id", "hits", "similarity", score.alias("score"), "rank")


def keyword_trigram_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_search(_questions(spark, sf_dir), _documents(spark, sf_dir), 15)


def keyword_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold a question literally."""
    found = B.literal_matches(_questions(spark, sf_dir).withColumnRenamed("item_id", "qid"), _documents(spark, sf_dir).withColumn("chunk_index", F.lit(0)))
    return found.select(F.col("qid").alias("item_id"), "document_id")


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return rows, rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("query"))


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.nearest(*_vectors(spark, sf_dir), 20)


def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.nearest(*_vectors(spark, sf_dir), 20, "label")


def vector_topk_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Among the vectors of documents that carry a label of high quality only."""
    rows, queries = _vectors(spark, sf_dir)
    good = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("vec_id")).distinct()
    return B.nearest(rows.join(good, "vec_id", "left_semi"), queries, 20)


def merged_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector and keyword results of the same questions as one ranking: the 25 best of each question."""
    vectors = vector_topk(spark, sf_dir).select((F.col("query_id") / 20).cast("long").alias("item_id"), F.col("vec_id").alias("document_id"), "similarity")
    merged = merge_ranked(vectors, keyword_trigram_search(spark, sf_dir))
    return merged.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("combined"), "document_id"))).filter("rank <= 25")


QUERIES = {f.__name__: f for f in (hybrid_rank_top5, keyword_trigram_search, keyword_exact, vector_topk, vector_topk_filtered, vector_topk_scoped, merged_ranking)}
_BOOST = "CASE " + " ".join(f"WHEN {T.sql_any('question', a)} AND {T.sql_any('doc_type', b)} THEN {x}::DOUBLE" for a, b, x in BOOSTS) + " ELSE 0::DOUBLE END"
_PAIRS = f"""WITH q AS (SELECT item_id, text, {T.sql_query_terms('text')} AS terms, {T.sql_trigrams('text')} AS g FROM benchmark),
c AS (SELECT doc_id AS document_id, source AS doc_type, coalesce(text, '') AS content, lower('Document ' || doc_id || ' ' || source || ' ' || substr(coalesce(text, ''), 1, {HEAD})) AS head FROM documents),
d AS (SELECT *, {T.sql_terms('head')} AS terms, {T.sql_trigrams('content')} AS g FROM c),
p AS (SELECT item_id, document_id, q.text AS question, doc_type, content, len(list_intersect(q.terms, d.terms)) AS hits, len(list_intersect(q.g, d.g)) AS both_n, len(q.g) + len(d.g) AS n FROM q, d),
s AS (SELECT *, round(both_n / (n - both_n), 6) AS similarity, contains(lower(content), lower(question)) AS exact FROM p)
"""
_COSINE = "round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6)"
_VECTOR = f"SELECT q.vec_id AS query_id, e.vec_id, {_COSINE} AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COSINE} DESC, e.vec_id) AS rank FROM embeddings q JOIN embeddings e ON %s WHERE q.vec_id %% 20 = 0 QUALIFY rank <= 20"
_KEYWORD = f"SELECT item_id, document_id, CASE WHEN exact THEN 1.0::DOUBLE ELSE similarity END AS rank_score, row_number() OVER (PARTITION BY item_id ORDER BY exact DESC, rank_score DESC, document_id) AS rank FROM s WHERE exact OR similarity >= {MINIMUM} QUALIFY rank <= 15"
ORACLE_SQL = {
    "hybrid_rank_top5": _PAIRS + f"SELECT item_id, document_id, hits, similarity, round(0.3::DOUBLE * similarity + {_BOOST} + 0.18::DOUBLE * hits - CASE WHEN {T.sql_any('content', T.SUPERSEDED)} THEN 0.18::DOUBLE ELSE 0 END, 7) AS score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, document_id) AS rank FROM s WHERE similarity >= {MINIMUM} QUALIFY rank <= 5",
    "keyword_trigram_search": _PAIRS + _KEYWORD,
    "keyword_exact": "SELECT item_id, doc_id AS document_id FROM benchmark b, documents d WHERE contains(lower(d.text), lower(b.text))",
    "vector_topk": _VECTOR % "true",
    "vector_topk_filtered": _VECTOR % "q.label = e.label",
    "vector_topk_scoped": _VECTOR % "e.vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "merged_ranking": _PAIRS + f", k AS ({_KEYWORD}), v AS ({_VECTOR % 'true'}), m AS (SELECT coalesce(v.query_id // 20, k.item_id) AS item_id, coalesce(v.vec_id, k.document_id) AS document_id, coalesce(v.similarity, 0)::DOUBLE AS vector_score, coalesce(k.rank_score, 0)::DOUBLE AS keyword_score FROM v FULL JOIN k ON v.query_id // 20 = k.item_id AND v.vec_id = k.document_id) SELECT *, round(0.7::DOUBLE * vector_score + 0.3::DOUBLE * keyword_score, 7) AS combined, row_number() OVER (PARTITION BY item_id ORDER BY combined DESC, document_id) AS rank FROM m QUALIFY rank <= 25",
}
