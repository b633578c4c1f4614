"""The tables at hand as the engine's logical tables; the only place that knows their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, title, content, doc_type, content_hash; a null text is an empty one."""
    content = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), content.alias("content"), F.col("source").alias("doc_type"), F.sha2(content, 256).alias("content_hash"))


def _id(prefix: str, column: str) -> F.Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, name of all nodes of the property graph."""
    out = None
    for name, label, prefix, key, title in [("region", "Location", "R-", "r_regionkey", "r_name"), ("nation", "Location", "N-", "n_nationkey", "n_name"), ("customer", "Person", "C-", "c_custkey", "c_name"), ("supplier", "Organization", "S-", "s_suppkey", "s_name"), ("part", "Product", "P-", "p_partkey", "p_name"), ("orders", "Document", "doc-", "o_orderkey", "o_orderpriority")]:
        one = table(spark, sf_dir, name).select(_id(prefix, key).alias("id"), F.lit(label).alias("label"), F.col(title).alias("name"))
        out = one if out is None else out.unionByName(one)
    return out


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, rel_type, dst, source_doc: one row each time an edge was asserted, source_doc null for master data."""
    t = lambda name: table(spark, sf_dir, name)
    nothing = F.lit(None).cast("long")

    def edge(df: DataFrame, src: F.Column, rel: str, dst: F.Column, doc: F.Column) -> DataFrame:
        return df.select(src.alias("src"), F.lit(rel).alias("rel_type"), dst.alias("dst"), doc.alias("source_doc"))

    out = edge(t("orders"), _id("doc-", "o_orderkey"), "INVOICED_TO", _id("C-", "o_custkey"), F.col("o_orderkey"))
    for one in [
        edge(t("lineitem"), _id("doc-", "l_orderkey"), "PROVIDER_FOR", _id("S-", "l_suppkey"), F.col("l_orderkey")),
        edge(t("lineitem"), _id("doc-", "l_orderkey"), "MENTIONS", _id("P-", "l_partkey"), F.col("l_orderkey")),
        edge(t("customer"), _id("C-", "c_custkey"), "LOCATED_IN", _id("N-", "c_nationkey"), nothing),
        edge(t("supplier"), _id("S-", "s_suppkey"), "LOCATED_IN", _id("N-", "s_nationkey"), nothing),
        edge(t("nation"), _id("N-", "n_nationkey"), "LOCATED_IN", _id("R-", "n_regionkey"), nothing),
    ]:
        out = out.unionByName(one)
    return out


SQL = """WITH RECURSIVE nodes AS (
SELECT 'R-' || r_regionkey AS id, 'Location' AS label, r_name AS name FROM region UNION ALL SELECT 'N-' || n_nationkey, 'Location', n_name FROM nation
UNION ALL SELECT 'C-' || c_custkey, 'Person', c_name FROM customer UNION ALL SELECT 'S-' || s_suppkey, 'Organization', s_name FROM supplier
UNION ALL SELECT 'P-' || p_partkey, 'Product', p_name FROM part UNION ALL SELECT 'doc-' || o_orderkey, 'Document', o_orderpriority FROM orders),
assertions AS (
SELECT 'doc-' || o_orderkey AS src, 'INVOICED_TO' AS rel_type, 'C-' || o_custkey AS dst, o_orderkey AS source_doc FROM orders
UNION ALL SELECT 'doc-' || l_orderkey, 'PROVIDER_FOR', 'S-' || l_suppkey, l_orderkey FROM lineitem
UNION ALL SELECT 'doc-' || l_orderkey, 'MENTIONS', 'P-' || l_partkey, l_orderkey FROM lineitem
UNION ALL SELECT 'C-' || c_custkey, 'LOCATED_IN', 'N-' || c_nationkey, NULL FROM customer
UNION ALL SELECT 'S-' || s_suppkey, 'LOCATED_IN', 'N-' || s_nationkey, NULL FROM supplier
UNION ALL SELECT 'N-' || n_nationkey, 'LOCATED_IN', 'R-' || n_regionkey, NULL FROM nation),
edges AS (SELECT src, rel_type, dst, count(*) AS weight, max(source_doc) AS last_doc FROM assertions GROUP BY ALL),
ends AS (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges)
"""
