"""Vectors in lists by centroid: a query looks into the lists of its nearest centroids, as many as a measured recall needs.

Centroids are learnt from a bounded sample; every row is in the list of one of them, stored by
list. blocksearch.nearest is the exact way beside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.operators import blocksearch as B
from loamgraph.session import reachable, shared_path
from loamgraph.sources.bindings import table

#: Lists, rows they are learnt from, rounds of learning, and queries on which recall is measured.
LISTS, SAMPLE, ROUNDS, ASKED = 32, 8192, 12, 256


def _clean(column: str) -> F.Column:
    return F.transform(F.coalesce(F.col(column), F.array().cast("array<double>")), lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _padded(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : min(len(v), width)] = v[:width]
    return _unit(out)


def learn(rows: DataFrame, lists: int = LISTS) -> np.ndarray:
    """Unit centroids of (vec_id, embedding) rows, from at most SAMPLE of them chosen by the hash of their ids. One of zeros for an empty table."""
    some = [r.vec for r in rows.select("vec_id", _clean("embedding").alias("vec")).filter("size(vec) > 0").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()]
    if not some:
        return np.zeros((1, 1))
    x = _padded(some, max(map(len, some)))
    centres = x[: min(lists, len(x))].copy()
    for _ in range(ROUNDS):
        of = (x @ centres.T).argmax(1)
        for j in np.unique(of).tolist():
            centres[j] = x[of == j].mean(0)
        centres = _unit(centres)
    return centres


def _placed(rows: DataFrame, centres: np.ndarray, most: int, schema: str) -> DataFrame:
    """rows (id, vec) with the numbers of their nearest centroids, at most so many, ties to the smaller."""
    reachable(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = np.argsort(-(_padded(b.column(1).to_pylist(), centres.shape[1]) @ centres.T), axis=1, kind="stable")[:, :most]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(near), pa.list_(pa.int64()))], names=["id", "vec", "lists"])

    return rows.mapInArrow(run, schema)


SCHEMA = "id long, vec array<double>, lists array<long>"


def build(rows: DataFrame, centres: np.ndarray, path: str) -> DataFrame:
    """Write all rows (vec_id, embedding) by list below ``path``; null vectors count as empty, components as 0. Gives id, vec, list."""
    placed = _placed(rows.select(F.col("vec_id").cast("long").alias("id"), _clean("embedding").alias("vec")), centres, 1, SCHEMA)
    placed.select("id", "vec", F.col("lists")[0].alias("list")).write.partitionBy("list").parquet(path)
    return rows.sparkSession.read.schema("id long, vec array<double>, list long").parquet(path)


def search(index: DataFrame, queries: DataFrame, centres: np.ndarray, k: int, probes: int) -> DataFrame:
    """query_id, vec_id, similarity, rank of queries (query_id, query) in the lists of their ``probes`` nearest centroids. Lists of more than blocksearch.VECTORS rows are split, so no task holds one whole."""
    largest = index.groupBy("list").count().agg(F.max("count")).first()[0] or 0
    parts = 1 + largest // B.VECTORS
    asked = _placed(queries.select(F.col("query_id").cast("long").alias("id"), _clean("query").alias("vec")), centres, probes, SCHEMA)
    rows = index.select(F.col("list").alias("a"), F.pmod(F.xxhash64("id"), F.lit(parts)).alias("b"), F.lit(False).alias("asked"), "id", "vec")
    every = asked.select("id", "vec", F.explode("lists").alias("a")).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return B.in_grid(rows.unionByName(every.withColumn("asked", F.lit(True))).withColumn("wanted", F.lit(0).cast("long")), k)


def probes_for(index: DataFrame, rows: DataFrame, queries: DataFrame, centres: np.ndarray, k: int, recall: float = 0.9) -> tuple[int, float]:
    """The least of 1, 2, 4, ... lists (at last all of them) with which some ASKED queries find so much of their true k best, and what they find."""
    some = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(ASKED)
    true = {(r.query_id, r.vec_id) for r in B.nearest(rows, some, k).collect()}  # at most ASKED * k
    n = 1
    while True:
        got = {(r.query_id, r.vec_id) for r in search(index, some, centres, k, n).collect()}
        found = len(true & got) / max(1, len(true))
        if found >= recall or n >= len(centres):
            return n, found
        n = min(2 * n, len(centres))


def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A twentieth of the vectors against an index of all, 20 of each, with as many lists as a recall of 0.9 needs."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    queries = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    centres = learn(rows)
    index = build(rows, centres, shared_path(spark, "vector-index"))
    return search(index, queries, centres, 20, probes_for(index, rows, queries, centres, 20)[0])


QUERIES = {"vector_index_topk": vector_index_topk}
ORACLE_SQL: dict[str, str] = {}
