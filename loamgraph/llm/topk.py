"""Exact top-k search by inner product over integer vectors, block at a time.

A component is a term, its value the term's weight. Vectors lie in ranges of ``RANGE`` ids,
each cut into blocks of at most ``BLOCK`` similar ones, by halving along the direction of most
spread; a block keeps its largest and least value of every term. For a query the sum of its
weights times these bounds what any vector of the block can score. Each query visits the
blocks by its own falling bounds, each scored through its forward index (the vectors
themselves), until the next bound falls below the k-th score, which it keeps from range to
range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.llm._common import stored
from loamgraph.llm.tiles import tiles, usable, wider

BLOCK, RANGE, QUERIES = 128, 8192, 1024
#: Tiles of queries whose best a task holds.
HELD = 128
#: Components from here on have no integer of 64 bits.
TOO_LARGE = float(1 << 57)
#: Below every score.
NONE = -(1 << 140)


def _blocks(d: np.ndarray, block: int) -> list[np.ndarray]:
    """Rows in blocks of at most so many, halved again and again along the direction of most spread."""
    out, todo = [], [np.arange(len(d))]
    while todo:
        at = todo.pop()
        if len(at) <= block:
            out.append(at)
            continue
        x = d[at].astype(np.float64)
        x -= x.mean(0)
        top = np.abs(x).max(initial=0) or 1.0
        _, v = np.linalg.eigh((x / top).T @ (x / top))
        order = np.argsort(x @ v[:, -1], kind="stable")
        todo += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
    return out


def _kind(q: np.ndarray, d: np.ndarray) -> type:
    """A type that holds all sums of products exactly."""
    top = q.shape[1] * int(np.abs(q).max(initial=0)) * int(np.abs(d).max(initial=0))
    return np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else object


class Best:
    """Scores and ids of the best of each query so far, and the visits that better them."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, k: int):
        self.queries, self.query_ids, self.k = queries, query_ids, k
        self.scores, self.ids = np.full((len(queries), k), -(1 << 62), np.int64), np.full((len(queries), k), -1, np.int64)
        self.visited = self.pairs = 0

    @property
    def none(self) -> int:
        return NONE if self.scores.dtype == object else -(1 << 62)

    def visit(self, docs: np.ndarray, doc_ids: np.ndarray, starts: np.ndarray) -> None:
        """Docs in blocks that begin at these rows. Each query takes its next blocks of highest bound, four times as many as the turn before, until the next bound falls below its k-th score."""
        width = max(self.queries.shape[1], docs.shape[1])
        q, d = wider(self.queries, width), wider(docs, width)
        kind = object if self.scores.dtype == object else _kind(q, d)
        if kind is object and self.scores.dtype != object:
            old = self.scores
            self.scores = old.astype(object)
            self.scores[old == -(1 << 62)] = NONE
        q, d = q.astype(kind), d.astype(kind)
        high, low = np.maximum.reduceat(d, starts, 0), np.minimum.reduceat(d, starts, 0)
        zero = q * 0
        bound = np.maximum(q, zero) @ high.T + np.minimum(q, zero) @ low.T
        by = np.argsort(-bound, axis=1, kind="stable") if kind is not object else np.array([sorted(range(len(starts)), key=lambda j: -int(x[j])) for x in bound], np.int64).reshape(bound.shape)
        ends = np.append(starts[1:], len(d))
        self.pairs += bound.size
        done, size = 0, 1
        while done < len(starts):
            at = by[:, done : done + size]
            least = self.scores[:, -1]
            row, col = np.nonzero(np.take_along_axis(bound, at, 1) >= least[:, None])  # an equal score may still win by its id
            if not len(row):
                break  # the bounds fall: whoever is done stays so
            self.visited += len(row)
            of = at[row, col]
            order = np.argsort(of, kind="stable")
            row, of = row[order], of[order]
            cuts = np.flatnonzero(np.diff(of, prepend=-1, append=-1))
            limit = least.astype(kind)
            hits = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                who, x, y = row[a:b], starts[of[a]], ends[of[a]]
                scores = q[who] @ d[x:y].T
                r, c = np.nonzero(scores >= limit[who][:, None])
                hits.append((who[r], scores[r, c], doc_ids[x + c]))
            self._take(*(np.concatenate(x) for x in zip(*hits)))
            done, size = done + size, size * 4

    def _take(self, row: np.ndarray, score: np.ndarray, doc_id: np.ndarray) -> None:
        keep = self.query_ids[row] != doc_id
        row, score, doc_id = row[keep], score[keep].astype(self.scores.dtype), doc_id[keep]
        who = np.unique(row)
        row = np.concatenate([row, np.repeat(who, self.k)])
        score, doc_id = np.concatenate([score, self.scores[who].ravel()]), np.concatenate([doc_id, self.ids[who].ravel()])
        if score.dtype == object:
            order = np.array(sorted(range(len(row)), key=lambda i: (row[i], -score[i], doc_id[i])), np.int64)
        else:
            order = np.lexsort((doc_id, -score, row))
        row, score, doc_id = row[order], score[order], doc_id[order]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        at = np.arange(len(row)) - np.repeat(first, np.diff(first, append=len(row)))
        best = at < self.k
        self.scores[row[best], at[best]], self.ids[row[best], at[best]] = score[best], doc_id[best]


def search(queries: np.ndarray, query_ids: np.ndarray, docs: np.ndarray, doc_ids: np.ndarray, k: int, block: int = BLOCK, scored: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of each query's k best among other docs, ties to the smaller id; a score below every sum of longs stands for none.

    scored, if given, gets the pairs of query and block that were scored, and all of them.
    """
    rows = _blocks(docs, block)
    at, starts = np.concatenate(rows), np.cumsum([0, *map(len, rows[:-1])])
    best = Best(queries, query_ids, k)
    best.visit(docs[at], doc_ids[at], starts)
    if scored is not None:
        scored += [best.visited, best.pairs]
    return best.scores, best.ids


def _blocked(ranges: DataFrame) -> DataFrame:
    """Tiles with their rows laid in blocks, as the narrowest integers that hold them."""
    schema = pa.schema([("tile", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("kind", pa.string()), ("data", pa.binary()), ("starts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tile, n, ids, data in zip(*(c.to_pylist() for c in b.columns)):
                x = np.frombuffer(data, "<i8").reshape(n, -1)
                rows = _blocks(x, BLOCK)
                at, starts = np.concatenate(rows), np.cumsum([0, *map(len, rows[:-1])])
                kind = next(t for t in ("<i2", "<i4", "<i8") if x.min(initial=0) >= np.iinfo(t).min and x.max(initial=0) <= np.iinfo(t).max)
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((tile, n, np.frombuffer(ids, "<i8")[at].tobytes(), kind, x[at].astype(kind).tobytes(), starts.astype("<i8").tobytes()), schema)], schema=schema)

    return ranges.select("tile", "n", "ids", "data").mapInArrow(run, "tile long, n long, ids binary, kind string, data binary, starts binary")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, vec: str = "embedding", vec_id: str = "vec_id", scale: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best by the inner product of floor(scale * x).

    Queries are rows of ``vectors``; a query is no candidate of its own. Vectors that are null or
    empty or hold null or non-finite components take no part, nor do rows with a null id. Missing
    components of shorter vectors count as 0. Rows that repeat an id are candidates one by one (and
    none of them for the query of that id, which comes once for each of them). Fewer than k
    candidates give all of them. Vectors with a component of 2 ** 57 or more, whose integer would
    not fit 64 bits, take no part; a score beyond 64 bits is the largest or least of them.
    """
    fits = F.forall(F.col(vec), lambda x: F.abs(x.cast("double") * scale) < F.lit(TOO_LARGE * 64))
    good = vectors.filter(usable(vec) & F.col(vec_id).isNotNull()).filter(fits)
    ints = F.transform(F.col(vec), lambda x: F.floor(x.cast("double") * scale))
    rows = good.select(F.col(vec_id).cast("long").alias("id"), F.lit(1).alias("weight"), F.col(vec_id).cast("double").alias("key"), ints.alias("vec"), F.coalesce(is_query, F.lit(False)).alias("q"))
    ranges = stored(_blocked(tiles(rows, RANGE, ["id"], "<i8")))
    asked = stored(_blocked(tiles(rows.filter("q"), QUERIES, ["id"], "<i8"))).drop("starts")
    # Each tile of queries meets every range where the ranges are read: neither is dealt or broadcast, as either times the other grows with the square of the rows.
    pairs = ranges.hint("shuffle_replicate_nl").crossJoin(asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns]))
    schema = pa.schema([("query_id", pa.int64()), ("score", pa.list_(pa.int64())), ("vec_id", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Best] = {}  # queries keep their k-th scores from range to range

        def out() -> Iterator[pa.RecordBatch]:
            for best in held.values():
                has = [s > best.none for s in best.scores]
                longs = [np.array([max(-(1 << 63), min((1 << 63) - 1, int(v))) for v in s[h]], np.int64) if s.dtype == object else s[h] for s, h in zip(best.scores, has)]
                yield pa.RecordBatch.from_arrays([pa.array(best.query_ids), pa.array(longs, schema.field(1).type), pa.array([f[h] for f, h in zip(best.ids, has)], schema.field(2).type)], schema=schema)
            held.clear()

        for b in batches:
            for i in range(b.num_rows):
                _, n, ids, kind, data, starts, tile, qn, qids, qkind, qdata = (c[i].as_py() for c in b.columns)
                if tile not in held:
                    if len(held) >= HELD:
                        yield from out()
                    held[tile] = Best(np.frombuffer(qdata, qkind).reshape(qn, -1).astype(np.int64), np.frombuffer(qids, "<i8"), k)
                held[tile].visit(np.frombuffer(data, kind).reshape(n, -1).astype(np.int64), np.frombuffer(ids, "<i8"), np.frombuffer(starts, "<i8"))
        yield from out()

    parts = pairs.mapInArrow(run, "query_id long, score array<long>, vec_id array<long>")
    scored = F.arrays_zip(F.transform("score", lambda x: F.bitwise_not(x)).alias("s"), F.col("vec_id").alias("v"))  # ~x falls as x rises, and always fits
    best = parts.select("query_id", scored.alias("top")).groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
    out = best.select("query_id", F.posexplode("top").alias("p", "t"))
    return out.select("query_id", (F.col("p") + 1).alias("rank"), F.col("t.v").alias("vec_id"), F.bitwise_not(F.col("t.s")).alias("score"))


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
