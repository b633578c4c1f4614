"""Embedding near-duplicates by an exact subspace pigeonhole join.

For unit vectors a cosine of at least c is a squared distance of at most 2 - 2c. Vectors are
rotated, so that no block of components holds most of the distance by chance, and split into
``BLOCKS`` blocks. If the blocks' budgets, proportional to their sizes, add up to that
distance, a near pair keeps within the budget of at least one block: each block is joined by
range under its budget, and the union of the candidates is checked exactly in double
precision on the vectors themselves.

Equal vectors are one node. Nodes lie in tiles in the order of one rotated component; tiles
meet only where their ranges of it are near enough. Links are counted where they are found
and leave as a star for each connected part of a pair of tiles, never as all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.llm._common import stored
from loamgraph.llm.components import components, stars
from loamgraph.llm.tiles import is_float, tiles, usable, wider

TILE, BLOCKS = 2048, 4
#: Largest components between which squares and their sums are far from the limits of doubles.
SAFE = (1e-100, 1e100)


def _safe(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1, keepdims=True, initial=0)
    odd = (top < SAFE[0]) | (top > SAFE[1])
    return x / np.where(odd, top, 1.0) if odd.any() else x


def rotation(width: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(20240229).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def candidates(a: np.ndarray, b: np.ndarray, limit: float, blocks: int = BLOCKS) -> np.ndarray:
    """Flat places (row of a times len(b) plus row of b) of pairs within a block's budget; a and b are rotated unit vectors."""
    found = []
    for part in np.array_split(np.arange(a.shape[1]), min(blocks, a.shape[1])):
        x, y = a[:, part].astype(np.float32), b[:, part].astype(np.float32)
        one = np.ones((len(x), 1), np.float32)
        left = np.concatenate([-2 * x, (x * x).sum(1, keepdims=True), one], 1)
        right = np.concatenate([y, np.ones((len(y), 1), np.float32), (y * y).sum(1, keepdims=True)], 1)
        budget = np.float32(limit * len(part) / a.shape[1] + 1e-5)  # above the rounding of single precision
        found.append(np.flatnonzero((left @ right.T).ravel() <= budget))
    return np.unique(np.concatenate(found))


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, vec: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    n_links counts other rows with a cosine of at least ``cosine``; component_id is the smallest
    vec_id that links reach; kept tells whether that is the row's own. Vectors that are null,
    empty or zero or hold null or non-finite components link with nothing, nor do rows with a
    null vec_id (null component). Shorter vectors count as padded with zeros. Rows that repeat a
    vec_id count one by one.
    """
    limit = 2 - 2 * cosine
    wide = F.transform(F.col(vec), lambda x: x.cast("double"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vec).alias("vec"), F.coalesce(usable(vec) & F.exists(wide, lambda x: x != 0) & F.col(vec_id).isNotNull(), F.lit(False)).alias("good"))
    rows = rows.withColumn("h", F.when(F.col("good"), F.xxhash64("vec", F.lit(7))))
    good = rows.filter("good")
    classes = stored(good.groupBy("h", "vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")))
    # One rotated component, the key of the order: any unit direction has |key(u) - key(v)| <= |u - v|.
    width = classes.agg(F.max(F.size("vec"))).first()[0] or 1
    turn = rotation(width)
    axis = F.array(*[F.lit(float(x)) for x in turn[:, 0]])
    # Vectors whose squares would leave the range of doubles are scaled by their largest component.
    top = F.array_max(F.transform(F.col("vec"), lambda x: F.abs(x.cast("double"))))
    unit = F.when(top.between(*SAFE), F.lit(1.0)).otherwise(top)
    doubles = F.transform(F.col("vec"), lambda x: x.cast("double") / unit)
    norm = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda s, x: s + x * x))
    dot = F.aggregate(F.zip_with(doubles, F.slice(axis, 1, F.size("vec")), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    dtype = "<f4" if is_float(vectors, vec) else "<f8"
    laid = stored(tiles(classes.select("id", "weight", (dot / norm).alias("key"), "vec"), TILE, ["key", "id"], dtype))
    reach = limit**0.5 + 1e-6
    spans = laid.select("tile", "lo", "hi", F.floor(F.col("lo") / reach).alias("c0"), F.floor(F.col("hi") / reach).alias("c1"))
    left = spans.select(F.col("tile").alias("t0"), F.col("lo").alias("lo0"), F.col("hi").alias("hi0"), F.explode(F.sequence(F.col("c0") - 1, F.col("c1") + 1)).alias("cell"))
    right = spans.select(F.col("tile").alias("t1"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"), F.explode(F.sequence("c0", "c1")).alias("cell"))
    meet = left.join(right, "cell").filter((F.col("t0") <= F.col("t1")) & (F.col("lo1") - F.col("hi0") <= reach) & (F.col("lo0") - F.col("hi1") <= reach)).select("t0", "t1").distinct()
    side = lambda s: laid.select(F.col("tile").alias(f"t{s}"), *[F.col(c).alias(f"{c}{s}") for c in ("n", "ids", "weights", "data")])
    pairs = meet.join(side(0), "t0").join(side(1), "t1").select("t0", "t1", "n0", "ids0", "weights0", "data0", "n1", "ids1", "weights1", "data1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(width)
        for b in batches:
            for t0, t1, n0, ids0, w0, x0, n1, ids1, w1, x1 in zip(*(c.to_pylist() for c in b.columns)):
                x, y = (wider(np.frombuffer(d, dtype).reshape(n, -1).astype(np.float64), width) for d, n in ((x0, n0), (x1, n1)))
                x, y = _safe(x), _safe(y)
                nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
                place = candidates(x / nx[:, None] @ turn, y / ny[:, None] @ turn, limit)
                i, j = place // n1, place % n1
                if t0 == t1:
                    i, j = i[i < j], j[i < j]
                near = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 65536]], y[j[k : k + 65536]]) / (nx[i[k : k + 65536]] * ny[j[k : k + 65536]]) >= cosine for k in range(0, len(i), 65536)] or [np.zeros(0, bool)])
                i, j = i[near], j[near] + (0 if t0 == t1 else n0)
                ids = np.frombuffer(ids0, "<i8") if t0 == t1 else np.concatenate([np.frombuffer(ids0, "<i8"), np.frombuffer(ids1, "<i8")])
                weight = np.frombuffer(w0, "<i8") if t0 == t1 else np.concatenate([np.frombuffer(w0, "<i8"), np.frombuffer(w1, "<i8")])
                n = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
                root = stars(i, j, len(ids))
                has = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({"node": pa.array(ids[has], pa.int64()), "n": pa.array(n[has].astype(np.int64)), "root": pa.array(ids[root[has]], pa.int64())})

    found = stored(pairs.mapInArrow(run, "node long, n long, root long"))
    reached = stored(components(found, "node", "root"))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    named = (
        classes.select("h", "vec", "id", "weight")
        .join(counts.withColumnRenamed("node", "id"), "id", "left")
        .join(reached.withColumnRenamed("node", "id"), "id", "left")
        .select("h", "vec", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    linked = good.join(named, ["h", "vec"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
