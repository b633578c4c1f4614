"""Names of a batch resolved against known entities: the same, alike enough, or new; and what a state holds for export."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.functions import fuzzy as Z
from loamgraph.functions import names as N
from loamgraph.operators import entities
from loamgraph.sources.bindings import SQL, assertions, nodes, source_documents, table


def people(named: DataFrame) -> DataFrame:
    """(name, person): each person that a name holds; null and empty names hold none."""
    return named.filter(F.trim("name") != "").select("name", F.explode(N.joint(F.col("name"))).alias("person")).distinct()


def resolve_same(named: DataFrame, known: DataFrame) -> DataFrame:
    """(label, name, id, how) of names (label, name): the known entity (label, id, name) of that label and name whatever its case, of several the smallest id, else a new one.

    Names that differ by case or outer blanks only are one entity; its id is then the first of
    them behind "new:". Null and empty names are left out.
    """
    key = F.lower(F.trim("name"))
    old = known.select("label", F.lower("name").alias("key"), "id").groupBy("label", "key").agg(F.min("id").alias("id"))
    new = named.filter(F.trim("name") != "").select("label", "name", key.alias("key")).distinct()
    out = new.join(old, ["label", "key"], "left")
    fresh = F.concat(F.lit("new:"), "label", F.lit(":"), "key")
    return out.select("label", "name", F.coalesce("id", fresh).alias("id"), F.when(F.col("id").isNull(), "created").otherwise("exact").alias("how"))


def resolve_organisations(named: DataFrame, known: DataFrame) -> DataFrame:
    """(name, id, how) of names of organisations against known ones (id, name, aliases).

    First by the normalised name, or an alias, whatever its case; then by the best score among
    those that share a distinctive word, as no others may be merged, if the safeguards let it;
    ties go to the smaller id. The rest is new, one for each normalised name. Names of fewer than
    three characters are left out. Only the pairs that share a word are compared: a word that is
    in very many names makes many, all of which count.
    """
    clean = N.name(N.org_name(F.col("name")))
    new = named.select("name").distinct().withColumn("clean", clean).filter(F.length("clean") >= 3)
    old = known.select("id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("known"), F.col("name").alias("main"))
    same = old.groupBy(F.lower("known").alias("key")).agg(F.min("id").alias("id"))
    exact = new.join(same, F.lower("clean") == F.col("key")).select("name", "id", F.lit("exact").alias("how"))
    rest = new.join(exact.select("name"), "name", "left_anti")
    a = rest.select("name", "clean", F.explode(N.distinctive(F.col("clean"))).alias("word"))
    b = old.select("id", "known", "main", F.explode(N.distinctive(F.col("main"))).alias("word"))
    pairs = a.join(b, "word").select("name", "clean", "id", "known", "main").distinct()
    scored = pairs.withColumn("score", Z.match(F.col("clean"), F.col("known"), False))
    top = scored.groupBy("name").agg(F.max("score").alias("top"))
    best = scored.join(top, "name").filter("score = top").groupBy("name", "clean", "score").agg(F.min_by("main", "id").alias("main"), F.min("id").alias("id"))
    alike = best.filter(entities.may_merge(F.col("clean"), F.col("main"), F.col("score"), False)).select("name", "id", F.lit("alike").alias("how"))
    made = rest.join(alike.select("name"), "name", "left_anti").select("name", F.concat(F.lit("new:"), F.lower("clean")).alias("id"), F.lit("created").alias("how"))
    return exact.unionByName(alike).unionByName(made)


def export(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write each table below ``path`` and give its manifest (name, rows) as read back."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    return manifest({name: spark.read.parquet(f"{path}/{name}") for name in tables})


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def joint_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers two by two: every third with "&", the others in a row with one surname."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Kim"), F.col("c_custkey")).alias("f"), F.concat(F.lit("Lee"), F.col("c_custkey") % 50).alias("s"))
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat("f", F.lit(" & Ann B "), "s")).otherwise(F.concat("f", F.lit(" "), "s", F.lit(" Ann B "), "s"))
    return people(c.select(name.alias("name")))


def resolve_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts and nations in capitals, of some with a suffix, against products and places."""
    some = lambda t, label, name, key: table(spark, sf_dir, t).select(F.lit(label).alias("label"), F.concat(F.upper(name), F.when(F.col(key) % 4 == 0, " New ").otherwise(" ")).alias("name"))
    return resolve_same(some("part", "Product", "p_name", "p_partkey").unionByName(some("nation", "Location", "n_name", "n_nationkey")), nodes(spark, sf_dir))


def resolve_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' names in capitals, with a suffix, and unknown ones against the suppliers."""
    s = table(spark, sf_dir, "supplier")
    known = s.select(F.concat(F.lit("S-"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.array(F.concat("s_name", F.lit(" Ltd"))).alias("aliases"))
    k = F.col("s_suppkey") % 3
    return resolve_organisations(s.select(F.when(k == 0, F.upper("s_name")).when(k == 1, F.concat("s_name", F.lit(" LTD"))).otherwise(F.concat(F.lit("Zorblat "), F.col("s_suppkey"))).alias("name")), known)


def export_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest({"nodes": nodes(spark, sf_dir), "assertions": assertions(spark, sf_dir), "documents": source_documents(spark, sf_dir)})


QUERIES = {f.__name__: f for f in (joint_names, resolve_generic, resolve_suppliers, export_manifest)}
ORACLE_SQL = {
    "joint_names": "SELECT name, unnest([f || ' ' || s, 'Ann B ' || s]) AS person FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN f || ' & Ann B ' || s ELSE f || ' ' || s || ' Ann B ' || s END AS name FROM (SELECT c_custkey, 'Kim' || c_custkey AS f, 'Lee' || c_custkey % 50 AS s FROM customer))",
    "resolve_generic": SQL + "SELECT DISTINCT label, name, coalesce((SELECT min(id) FROM nodes n WHERE n.label = x.label AND lower(n.name) = lower(trim(x.name))), 'new:' || label || ':' || lower(trim(name))) AS id, CASE WHEN EXISTS (SELECT 1 FROM nodes n WHERE n.label = x.label AND lower(n.name) = lower(trim(x.name))) THEN 'exact' ELSE 'created' END AS how FROM (SELECT 'Product' AS label, upper(p_name) || CASE WHEN p_partkey % 4 = 0 THEN ' New ' ELSE ' ' END AS name FROM part UNION ALL SELECT 'Location', upper(n_name) || CASE WHEN n_nationkey % 4 = 0 THEN ' New ' ELSE ' ' END FROM nation) x",
    "resolve_suppliers": "SELECT CASE s_suppkey % 3 WHEN 0 THEN upper(s_name) WHEN 1 THEN s_name || ' LTD' ELSE 'Zorblat ' || s_suppkey END AS name, CASE WHEN s_suppkey % 3 = 2 THEN 'new:zorblat ' || s_suppkey ELSE 'S-' || s_suppkey END AS id, CASE WHEN s_suppkey % 3 = 2 THEN 'created' ELSE 'exact' END AS how FROM supplier",
    "export_manifest": SQL + "SELECT 'nodes' AS name, count(*) AS rows FROM nodes UNION ALL SELECT 'assertions', count(*) FROM assertions UNION ALL SELECT 'documents', count(*) FROM documents",
}
