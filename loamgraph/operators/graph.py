"""The property graph: edges derived from assertions, degrees, traversals and rewrites."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamgraph.session import settled
from loamgraph.sources.bindings import SQL, assertions, nodes


def edges(asserted: DataFrame) -> DataFrame:
    """One row for each edge: weight is how often it was asserted, last_doc who asserted it last."""
    return asserted.groupBy("src", "rel_type", "dst").agg(F.count("*").alias("weight"), F.max("source_doc").alias("last_doc"))


def degrees(edge: DataFrame) -> DataFrame:
    both = edge.groupBy(F.col("src").alias("id")).count().unionByName(edge.groupBy(F.col("dst").alias("id")).count())
    return both.groupBy("id").agg(F.sum("count").alias("degree"))


def both_ways(edge: DataFrame) -> DataFrame:
    """(src, dst) of all edges in either direction, once each."""
    return edge.select("src", "dst").unionByName(edge.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def neighbours(edge: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, distance) of all nodes within ``depth`` hops of any seed, either direction. Edges may repeat.

    Each hop's nodes are written, so that no hop works out those before it again and a few of them
    are sent to the edges, which then stay where they are read.
    """
    both = edge.select("src", "dst").unionByName(edge.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seen = settled(seeds.select("id").distinct().withColumn("distance", F.lit(0)))
    for d in range(1, depth + 1):
        front = settled(seen.filter(F.col("distance") == d - 1).select(F.col("id").alias("src")))
        reached = both.join(front, "src").select(F.col("dst").alias("id"), F.lit(d).alias("distance"))
        seen = settled(seen.unionByName(reached).groupBy("id").agg(F.min("distance").alias("distance")))
    return seen


def paths(edge: DataFrame, seeds: DataFrame, depth: int = 3, limit: int | None = None) -> DataFrame:
    """(seed, hops, node, nodes, steps): all paths of 1 to ``depth`` edges in either direction from seeds (id), no edge twice. Edges may repeat; those without one of their ends take no part.

    With a ``limit`` only the first so many of a seed and a number of hops, by their steps, come out
    and go on. A hop's few nodes are sent to the edges, so only those beside a path are made distinct.
    """
    step = F.concat_ws("|", "src", "rel_type", "dst").alias("step")
    none = F.array().cast("array<string>")
    ends = F.array(F.struct(F.col("src").alias("at"), F.col("dst").alias("to")), F.struct(F.col("dst").alias("at"), F.col("src").alias("to")))
    either = edge.filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "rel_type", "dst", F.inline(ends))
    level = settled(seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.array("id").alias("nodes"), none.alias("steps")).distinct())
    out = None
    for hops in range(1, depth + 1):
        front = settled(level.select(F.col("node").alias("at")).distinct())
        both = settled(either.join(front, "at", "left_semi").select("at", "to", step).distinct())
        more = level.join(both, level["node"] == both["at"]).filter(~F.array_contains("steps", F.col("step")))
        level = more.select("seed", F.col("to").alias("node"), F.array_append("nodes", F.col("to")).alias("nodes"), F.array_append("steps", F.col("step")).alias("steps"))
        if limit is not None:
            first = F.row_number().over(W.partitionBy("seed").orderBy("steps", "nodes"))
            level = level.withColumn("n", first).filter(F.col("n") <= limit).drop("n")
        if hops < depth:
            level = settled(level)
        rows = level.select("seed", F.lit(hops).alias("hops"), "node", "nodes", "steps")
        out = rows if out is None else out.unionByName(rows)
    return out


def inside(edge: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among these ids."""
    ids = ids.select("id").distinct()
    return edge.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def incident(edge: DataFrame) -> DataFrame:
    """Each edge from both of its ends: id, direction, rel_type, other."""
    out = edge.select(F.col("src").alias("id"), F.lit("out").alias("direction"), "rel_type", F.col("dst").alias("other"))
    return out.unionByName(edge.select(F.col("dst").alias("id"), F.lit("in").alias("direction"), "rel_type", F.col("src").alias("other")))


def search_nodes(node: DataFrame, query: str, label: str | None = None, limit: int = 20) -> DataFrame:
    """Nodes whose name holds most of the query's terms as substrings; ties to the later name."""
    terms = [t for t in re.findall("[a-z0-9]+", query.lower()) if len(t) >= 2]
    if label:
        node = node.filter(F.col("label") == label)
    matched = sum((F.contains(F.lower("name"), F.lit(t)).cast("int") for t in terms), F.lit(0))
    found = node.withColumn("matched", matched)
    if terms:
        found = found.filter("matched > 0")
    elif not label:
        found = found.limit(0)
    return found.orderBy(F.desc("matched"), F.desc("name"), F.desc("id")).limit(limit)


def without_document(node: DataFrame, asserted: DataFrame, document_id: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and assertions once a document is taken out: its node goes, what it asserted goes, and nodes that it leaves without an edge go."""
    gone = f"doc-{document_id}"
    by_it = (F.col("source_doc") == document_id) | (F.col("src") == gone) | (F.col("dst") == gone)
    left = asserted.filter(~F.coalesce(by_it, F.lit(False)))
    touched = asserted.filter(F.coalesce(by_it, F.lit(False))).select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    held = left.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    lost = touched.join(held, "id", "left_anti").unionByName(node.filter(F.col("id") == gone).select("id")).distinct()
    return node.join(lost, "id", "left_anti"), left


def merged_nodes(node: DataFrame, mapping: DataFrame) -> DataFrame:
    """Nodes that stay after a merge (id, keep), with the names of those merged into them as aliases, sorted."""
    names = mapping.join(node.select("id", "name"), "id").groupBy(F.col("keep").alias("id")).agg(F.collect_set("name").alias("names"))
    left = node.join(mapping, "id", "left_anti").join(names, "id", "left")
    others = F.array_sort(F.filter(F.coalesce("names", F.array().cast("array<string>")), lambda n: n != F.col("name")))
    return left.select("id", "label", "name", others.alias("aliases"))


def with_aliases(node: DataFrame, found: DataFrame) -> DataFrame:
    """Nodes (id, aliases) with the names (id, alias) found for them added, each once, whatever was there first."""
    new = found.groupBy("id").agg(F.array_sort(F.collect_set("alias")).alias("new"))
    return node.join(new, "id", "left").select("id", F.array_union("aliases", F.coalesce("new", F.array().cast("array<string>"))).alias("aliases"))


def orphans(node: DataFrame, edge: DataFrame) -> DataFrame:
    return node.join(edge.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id", "left_anti")


def merged(asserted: DataFrame, mapping: DataFrame) -> DataFrame:
    """Assertions with nodes replaced by what (id, keep) says; loops that this makes go."""
    src, dst = mapping.select(F.col("id").alias("src"), F.col("keep").alias("src2")), mapping.select(F.col("id").alias("dst"), F.col("keep").alias("dst2"))
    out = asserted.join(src, "src", "left").join(dst, "dst", "left").select("source_doc", "rel_type", F.coalesce("src2", "src").alias("src"), F.coalesce("dst2", "dst").alias("dst"))
    return out.filter("src <> dst")


def same_name_parts(node: DataFrame) -> DataFrame:
    return node.filter("label = 'Product'").select("id", F.min("id").over(W.partitionBy("name")).alias("keep")).filter("id <> keep")


def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).agg(F.count("*").alias("nodes"), F.count_if(F.col("label") == "Document").alias("documents"))
    return n.crossJoin(edges(assertions(spark, sf_dir)).agg(F.count("*").alias("relationships"))).select("nodes", "relationships", "documents", (F.col("nodes") - F.col("documents")).alias("entities"))


def edge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(assertions(spark, sf_dir)).select("src", "rel_type", "dst", "weight")


def edge_last_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(assertions(spark, sf_dir)).select("src", "rel_type", "dst", "last_doc")


def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).join(degrees(edges(assertions(spark, sf_dir))), "id", "left").select("id", "label", F.coalesce("degree", F.lit(0)).alias("degree"))


def graph_initial_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.row_number().over(W.partitionBy("label").orderBy(F.desc("degree"), "id"))
    return graph_degree(spark, sf_dir).withColumn("rank", top).filter("rank <= 50").select("label", "id", "degree", "rank")


def recent_docs_per_org(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = edges(assertions(spark, sf_dir)).filter("rel_type = 'PROVIDER_FOR'").select(F.col("dst").alias("org"), F.col("last_doc").alias("document_id"))
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy("org").orderBy(F.desc("document_id")))).filter("rank <= 3")


def docs_by_entity_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assertions(spark, sf_dir).filter("source_doc IS NOT NULL").join(nodes(spark, sf_dir).select(F.col("id").alias("dst"), "label"), "dst").select("label", F.col("source_doc").alias("document_id")).distinct()
    return found.withColumn("rank", F.row_number().over(W.partitionBy("label").orderBy(F.desc("document_id")))).filter("rank <= 40")


def document_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assertions(spark, sf_dir).filter("source_doc IS NOT NULL").select(F.col("source_doc").alias("document_id"), F.col("dst").alias("id")).distinct()
    return found.join(nodes(spark, sf_dir), "id").select("document_id", "id", "label", "name")


def node_neighbors_d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(assertions(spark, sf_dir), nodes(spark, sf_dir).filter("id LIKE 'R-%'"), 2)


def orphan_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes without an edge once the orders of every third customer are left out."""
    some = assertions(spark, sf_dir).filter("NOT (rel_type = 'INVOICED_TO' AND substr(dst, 3) % 3 = 0) AND NOT (rel_type = 'LOCATED_IN' AND src LIKE 'C-%')")
    return orphans(nodes(spark, sf_dir).filter("label <> 'Document'"), some)


def subgraph_d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges among the nodes within three hops of two suppliers, each once."""
    asserted = assertions(spark, sf_dir).filter("rel_type = 'LOCATED_IN'")
    seeds = nodes(spark, sf_dir).filter("id IN ('S-1', 'S-2')")
    return inside(edges(asserted), neighbours(asserted, seeds, 3)).select("src", "rel_type", "dst")


def graph_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All paths of up to three edges from three organisations and a person."""
    found = paths(assertions(spark, sf_dir), nodes(spark, sf_dir).filter("id IN ('S-1', 'S-2', 'S-7', 'C-4')"))
    return found.select("seed", "hops", "node", F.array_join("nodes", " ").alias("nodes"), F.array_join("steps", " ").alias("steps"))


def node_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organisations and places with how many edges of each kind and direction they have, and the first and last node there."""
    found = incident(edges(assertions(spark, sf_dir))).join(nodes(spark, sf_dir).filter("label IN ('Organization', 'Location')"), "id")
    return found.groupBy("id", "label", "name", "direction", "rel_type").agg(F.count("*").alias("edges"), F.min("other").alias("first"), F.max("other").alias("last"))


def graph_search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_nodes(nodes(spark, sf_dir), "the Red and 10 AF", limit=50).select("id", "label", "name", "matched")


def graph_search_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_nodes(nodes(spark, sf_dir), "", "Location", limit=12).select("id", "name")


def initial_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that the sampled nodes other than documents have, with their far ends."""
    sample = graph_initial_sample(spark, sf_dir).filter("label <> 'Document'").select("id")
    return incident(edges(assertions(spark, sf_dir))).join(sample, "id", "left_semi").select("id", "direction", "rel_type", "other")


def beside(asserted: DataFrame, node: DataFrame) -> DataFrame:
    """(id, edges, entities, labels): of assertions (id, direction, rel_type, other) the numbers of different edges and nodes beside each id, and these nodes' labels.

    Assertions move to the nodes and from there to their id, where repeated ones go and all is
    counted. Rows of nodes that share an id are numbered, as an edge counts for each.
    """
    copy = F.row_number().over(W.partitionBy("id").orderBy("label"))
    node = settled(node.select(F.col("id").alias("other"), "label", copy.alias("copy")))
    each = asserted.select("id", "direction", "rel_type", "other").join(node, "other").repartition("id").distinct()
    return each.groupBy("id").agg(F.count("*").alias("edges"), F.countDistinct("other").alias("entities"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))


def document_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the numbers of its edges and of different nodes and labels beside it."""
    return beside(incident(assertions(spark, sf_dir)).filter("id LIKE 'doc-%'"), nodes(spark, sf_dir))


def recent_docs_per_org_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two latest documents of organisations that lie in a place of region 1 or have an urgent document."""
    a = assertions(spark, sf_dir)
    orgs = nodes(spark, sf_dir).filter("label = 'Organization'").select("id")
    places = a.filter("rel_type = 'LOCATED_IN' AND dst = 'R-1'").select(F.col("src").alias("dst"))
    by_type = a.filter("rel_type = 'LOCATED_IN'").join(places, "dst", "left_semi").select(F.col("src").alias("id")).join(orgs, "id", "left_semi")
    urgent = nodes(spark, sf_dir).filter("label = 'Document' AND name = '1-URGENT'").select(F.col("id").alias("src"))
    provided = a.filter("rel_type = 'PROVIDER_FOR'")
    by_doc = provided.join(urgent, "src", "left_semi").select(F.col("dst").alias("id"))
    wanted = by_type.unionByName(by_doc).distinct()
    docs = provided.select(F.col("dst").alias("id"), F.col("source_doc").alias("document_id")).distinct().join(wanted, "id", "left_semi")
    return docs.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc("document_id")))).filter("rank <= 2")


def docs_touching_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the number of different products and organisations they touch, the latest forty."""
    touches = assertions(spark, sf_dir).filter("source_doc IS NOT NULL")
    return latest_touching(touches, nodes(spark, sf_dir).filter("label IN ('Product', 'Organization')").select(F.col("id").alias("dst")), 40)


def latest_touching(touches: DataFrame, wanted: DataFrame, limit: int, first: int = 1000) -> DataFrame:
    """The latest ``limit`` documents (source_doc) that touch (dst) a wanted node, with the number of different ones.

    Only the ``first`` latest documents meet the nodes; sixteen times as many, and so on, if too few of them touch one.
    """
    ids = settled(touches.select("source_doc").distinct())
    while True:
        least, n = ids.orderBy(F.desc("source_doc")).limit(first).agg(F.min("source_doc"), F.count("*")).first()
        found = touches.filter(F.col("source_doc") >= F.lit(least)).join(wanted, "dst", "left_semi")
        out = settled(found.groupBy(F.col("source_doc").alias("document_id")).agg(F.countDistinct("dst").alias("entities")).orderBy(F.desc("document_id")).limit(limit))
        if n < first or out.count() >= limit:
            return out.orderBy(F.desc("document_id"))
        first *= 16


def delete_document_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that are left once document 1 is taken out, by label."""
    left, _ = without_document(nodes(spark, sf_dir), assertions(spark, sf_dir).filter("rel_type <> 'LOCATED_IN'"), 1)
    return left.groupBy("label").agg(F.count("*").alias("nodes"))


def merge_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one first word merged into the first of them, the other names as aliases."""
    part = nodes(spark, sf_dir).filter("label = 'Product'")
    keep = part.select("id", F.min("id").over(W.partitionBy(F.substring_index("name", " ", 1))).alias("keep")).filter("id <> keep")
    return merged_nodes(part, keep).select("id", "name", F.array_join("aliases", "|").alias("aliases"))


def add_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their name and number as aliases, added to the name in capitals."""
    c = nodes(spark, sf_dir).filter("label = 'Person'")
    found = c.select("id", F.col("name").alias("alias")).unionByName(c.select("id", F.col("id").alias("alias"))).unionByName(c.select("id", F.upper("name").alias("alias")))
    return with_aliases(c.select("id", F.array(F.upper("name")).alias("aliases")), found).select("id", F.array_join("aliases", "|").alias("aliases"))


def find_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes whose name is one of these whatever its case."""
    return nodes(spark, sf_dir).filter(F.lower("name").isin("africa", "customer#000000001", "nation_3", "nation 3"))


def visible_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that a view shows which hides documents and nodes of fewer than three edges: both ends stay."""
    e = settled(edges(assertions(spark, sf_dir)))  # read three times
    shown = nodes(spark, sf_dir).filter("label <> 'Document'").join(degrees(e).filter("degree >= 3"), "id", "left_semi")
    return inside(e, shown).select("src", "rel_type", "dst")


def delete_document(spark: SparkSession, sf_dir: str, document_id: int = 1) -> DataFrame:
    """Edges that are left once a document is taken out; edges that others assert too stay, with less weight."""
    gone = f"doc-{document_id}"
    left = assertions(spark, sf_dir).filter(f"(source_doc IS NULL OR source_doc <> {document_id}) AND src <> '{gone}' AND dst <> '{gone}'")
    return edges(left).select("src", "rel_type", "dst", "weight")


def merge_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(merged(assertions(spark, sf_dir), same_name_parts(nodes(spark, sf_dir)))).select("src", "rel_type", "dst", "weight")


QUERIES = {
    f.__name__: f
    for f in (
        graph_counts, edge_weights, edge_last_writer, graph_degree, graph_initial_sample, initial_graph_edges, recent_docs_per_org, recent_docs_per_org_filtered, docs_by_entity_type,
        docs_touching_types, document_entities, document_detail, node_neighbors_d2, subgraph_d3, graph_paths, node_detail, graph_search_terms, graph_search_label, find_by_name, visible_graph,
        orphan_nodes, delete_document, delete_document_nodes, merge_nodes, merge_aliases, add_aliases,
    )
}
_DEGREE = ", degree AS (SELECT n.id, n.label, count(e.id) AS degree FROM nodes n LEFT JOIN ends e ON n.id = e.id GROUP BY ALL)"
_HOPS = ", both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), walk AS (SELECT id, 0 AS distance FROM nodes WHERE id LIKE 'R-%' UNION SELECT b.dst, w.distance + 1 FROM walk w JOIN both_ways b ON b.src = w.id WHERE w.distance < 2)"
_LEVEL = "p%d AS (SELECT seed, to_ AS node, list_append(nodes, to_) AS nodes, list_append(steps, step) AS steps FROM p%d p JOIN b ON b.at_ = p.node WHERE NOT list_contains(steps, step))"
ORACLE_SQL = {
    "graph_paths": SQL
    + ", s AS (SELECT src, dst, src || '|' || rel_type || '|' || dst AS step FROM edges), b AS (SELECT src AS at_, dst AS to_, step FROM s UNION ALL SELECT dst, src, step FROM s WHERE src <> dst), p0 AS (SELECT id AS seed, id AS node, [id] AS nodes, []::VARCHAR[] AS steps FROM nodes WHERE id IN ('S-1', 'S-2', 'S-7', 'C-4')), "
    + ", ".join(_LEVEL % (i, i - 1) for i in (1, 2, 3))
    + " " + " UNION ALL ".join(f"SELECT seed, {i} AS hops, node, array_to_string(nodes, ' ') AS nodes, array_to_string(steps, ' ') AS steps FROM p{i}" for i in (1, 2, 3)),
    "graph_counts": SQL + "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS relationships, (SELECT count(*) FROM nodes WHERE label = 'Document') AS documents, (SELECT count(*) FROM nodes WHERE label <> 'Document') AS entities",
    "edge_weights": SQL + "SELECT src, rel_type, dst, weight FROM edges",
    "edge_last_writer": SQL + "SELECT src, rel_type, dst, last_doc FROM edges",
    "graph_degree": SQL + _DEGREE + " SELECT * FROM degree",
    "graph_initial_sample": SQL + _DEGREE + " SELECT label, id, degree, row_number() OVER (PARTITION BY label ORDER BY degree DESC, id) AS rank FROM degree QUALIFY rank <= 50",
    "recent_docs_per_org": SQL + "SELECT dst AS org, last_doc AS document_id, row_number() OVER (PARTITION BY dst ORDER BY last_doc DESC) AS rank FROM edges WHERE rel_type = 'PROVIDER_FOR' QUALIFY rank <= 3",
    "docs_by_entity_type": SQL + "SELECT label, document_id, row_number() OVER (PARTITION BY label ORDER BY document_id DESC) AS rank FROM (SELECT DISTINCT n.label, a.source_doc AS document_id FROM assertions a JOIN nodes n ON a.dst = n.id WHERE a.source_doc IS NOT NULL) QUALIFY rank <= 40",
    "document_entities": SQL + "SELECT DISTINCT a.source_doc AS document_id, n.id, n.label, n.name FROM assertions a JOIN nodes n ON a.dst = n.id WHERE a.source_doc IS NOT NULL",
    "node_neighbors_d2": SQL + _HOPS + " SELECT id, min(distance) AS distance FROM walk GROUP BY id",
    "orphan_nodes": SQL + "SELECT * FROM nodes WHERE label <> 'Document' AND id NOT IN (SELECT unnest([src, dst]) FROM assertions WHERE NOT (rel_type = 'INVOICED_TO' AND substr(dst, 3)::BIGINT % 3 = 0) AND NOT (rel_type = 'LOCATED_IN' AND src LIKE 'C-%'))",
    "subgraph_d3": SQL + ", l AS (SELECT DISTINCT src, dst FROM assertions WHERE rel_type = 'LOCATED_IN'), u AS (SELECT src, dst FROM l UNION SELECT dst, src FROM l), w AS (SELECT id, 0 AS d FROM nodes WHERE id IN ('S-1', 'S-2') UNION SELECT u.dst, w.d + 1 FROM w JOIN u ON u.src = w.id WHERE w.d < 3) SELECT DISTINCT src, 'LOCATED_IN' AS rel_type, dst FROM l WHERE src IN (SELECT id FROM w) AND dst IN (SELECT id FROM w)",
    "node_detail": SQL + "SELECT n.id, n.label, n.name, direction, rel_type, count(*) AS edges, min(other) AS first, max(other) AS last FROM (SELECT src AS id, 'out' AS direction, rel_type, dst AS other FROM edges UNION ALL SELECT dst, 'in', rel_type, src FROM edges) e JOIN nodes n ON n.id = e.id WHERE label IN ('Organization', 'Location') GROUP BY ALL",
    "graph_search_terms": SQL + "SELECT id, label, name, contains(lower(name), 'the')::INT + contains(lower(name), 'red')::INT + contains(lower(name), 'and')::INT + contains(lower(name), '10')::INT + contains(lower(name), 'af')::INT AS matched FROM nodes WHERE matched > 0 ORDER BY matched DESC, name DESC, id DESC LIMIT 50",
    "graph_search_label": SQL + "SELECT id, name FROM nodes WHERE label = 'Location' ORDER BY name DESC, id DESC LIMIT 12",
    "initial_graph_edges": SQL + _DEGREE + ", top AS (SELECT id FROM degree WHERE label <> 'Document' QUALIFY row_number() OVER (PARTITION BY label ORDER BY degree DESC, id) <= 50) SELECT * FROM (SELECT src AS id, 'out' AS direction, rel_type, dst AS other FROM edges UNION ALL SELECT dst, 'in', rel_type, src FROM edges) WHERE id IN (SELECT id FROM top)",
    "document_detail": SQL + "SELECT e.id, count(*) AS edges, count(DISTINCT other) AS entities, array_to_string(list_sort(list_distinct(list(n.label))), ',') AS labels FROM (SELECT src AS id, dst AS other FROM edges UNION ALL SELECT dst, src FROM edges) e JOIN nodes n ON n.id = other WHERE e.id LIKE 'doc-%' GROUP BY 1",
    "recent_docs_per_org_filtered": SQL + ", w AS (SELECT a.src AS id FROM assertions a JOIN assertions b ON a.dst = b.src AND b.dst = 'R-1' AND a.rel_type = 'LOCATED_IN' AND b.rel_type = 'LOCATED_IN' WHERE a.src LIKE 'S-%' UNION SELECT a.dst FROM assertions a JOIN nodes n ON n.id = a.src AND n.name = '1-URGENT' WHERE rel_type = 'PROVIDER_FOR'), d AS (SELECT DISTINCT dst AS id, source_doc AS document_id FROM assertions WHERE rel_type = 'PROVIDER_FOR' AND dst IN (SELECT id FROM w)) SELECT *, row_number() OVER (PARTITION BY id ORDER BY document_id DESC) AS rank FROM d QUALIFY rank <= 2",
    "docs_touching_types": SQL + "SELECT source_doc AS document_id, count(DISTINCT dst) AS entities FROM assertions WHERE source_doc IS NOT NULL AND (dst LIKE 'P-%' OR dst LIKE 'S-%') GROUP BY 1 ORDER BY 1 DESC LIMIT 40",
    "delete_document_nodes": SQL + ", a AS (SELECT * FROM assertions WHERE rel_type <> 'LOCATED_IN'), k AS (SELECT * FROM a WHERE source_doc IS DISTINCT FROM 1), t AS (SELECT unnest([src, dst]) AS id FROM a WHERE source_doc = 1), lost AS (SELECT id FROM t EXCEPT SELECT unnest([src, dst]) FROM k) SELECT label, count(*) AS nodes FROM nodes WHERE id NOT IN (SELECT id FROM lost) AND id <> 'doc-1' GROUP BY 1",
    "merge_aliases": SQL + ", p AS (SELECT id, name, min(id) OVER (PARTITION BY string_split(name, ' ')[1]) AS keep FROM nodes WHERE label = 'Product') SELECT k.id, k.name, coalesce(array_to_string(list_sort(list_distinct(list(m.name) FILTER (m.name <> k.name))), '|'), '') AS aliases FROM p k LEFT JOIN p m ON m.keep = k.id AND m.id <> k.id WHERE k.id = k.keep GROUP BY ALL",
    "add_aliases": SQL + "SELECT id, array_to_string(list_concat([upper(name)], list_filter(list_sort(list_distinct([name, id])), lambda x: x <> upper(name))), '|') AS aliases FROM nodes WHERE label = 'Person'",
    "find_by_name": SQL + "SELECT * FROM nodes WHERE lower(name) IN ('africa', 'customer#000000001', 'nation_3', 'nation 3')",
    "visible_graph": SQL + ", d AS MATERIALIZED (SELECT id, count(*) AS degree FROM ends GROUP BY 1), s AS MATERIALIZED (SELECT n.id FROM nodes n JOIN d ON d.id = n.id WHERE n.label <> 'Document' AND d.degree >= 3) SELECT e.src, e.rel_type, e.dst FROM edges e JOIN s a ON a.id = e.src JOIN s b ON b.id = e.dst",
    "delete_document": SQL + "SELECT src, rel_type, dst, count(*) AS weight FROM assertions WHERE source_doc IS DISTINCT FROM 1 AND src <> 'doc-1' AND dst <> 'doc-1' GROUP BY ALL",
    "merge_nodes": SQL + ", m AS (SELECT id, min(id) OVER (PARTITION BY name) AS keep FROM nodes WHERE label = 'Product') SELECT src, rel_type, coalesce(m.keep, dst) AS dst, count(*) AS weight FROM assertions LEFT JOIN m ON dst = m.id GROUP BY ALL",
}
