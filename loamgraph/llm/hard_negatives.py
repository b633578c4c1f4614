"""Hard negatives from vantage-point trees over norm-augmented vectors.

With one more component, sqrt(M ** 2 - |x| ** 2), all vectors x of a group lie on a sphere, and
a query q (whose component is 0) is the nearer to x the larger their inner product: d ** 2 =
|q| ** 2 + M ** 2 - 2 q.x. A window of scores is thus an annulus around the query. A tree of
vantage points bounds the distance of every leaf from both sides by the triangle inequality, so
leaves outside the annulus are not opened, and those inside are opened nearest first until k
rows are found that no unopened leaf can better. Bounds only prune: scores are exact integers.

Rows lie in groups of at most ``GROUP``, in the order of a coarse tree whose vantage points come
from a bounded sample. Anchors search their own group first; the k-th score found there narrows
the window in which they search the other groups. Anchors and groups meet in a grid, so a task
holds one group, and at most ``SLICE`` anchors pass it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamgraph.llm._common import read, stored
from loamgraph.session import reachable

GROUP, LEAF, SLICE = 65_536, 256, 65_536
#: Anchors searched at once; leaves that each visits one at a time before the rest.
CHUNK, TURNS = 512, 4
#: Rows on which the coarse tree is fitted, chosen by the hash of their ids, and its leaves.
SAMPLE, CELLS = 4096, 256
#: Integer components from here on (scores of up to 2048 of them could exceed 64 bits).
TOO_LARGE = 1 << 26
NONE, MOST = -(1 << 63), (1 << 63) - 1


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as int64, the missing components of shorter ones as zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy().astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _augmented(x: np.ndarray, m2: float | None = None) -> tuple[np.ndarray, float]:
    x = x.astype(np.float64)
    n2 = (x * x).sum(1)
    m2 = float(n2.max(initial=0)) if m2 is None else m2
    return np.column_stack([x, np.sqrt(np.maximum(m2 - n2, 0))]), m2


def _distances(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - v) ** 2).sum(1))


def _split(x: np.ndarray, at: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """A vantage point far from the middle of these rows, and their nearer and farther half."""
    y = x[at]
    v = int(at[((y - y.mean(0)) ** 2).sum(1).argmax()])
    order = at[np.argsort(_distances(y, x[v]), kind="stable")]
    return v, order[: len(at) // 2], order[len(at) // 2 :]


class VantageTree:
    """Exact k best by integer inner product within windows of scores."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, leaf: int = LEAF):
        self.x, self.ids, self.labels = x, ids, labels
        self.largest = int(np.abs(x).max(initial=0))
        full, self.m2 = _augmented(x)
        self.leaves: list[np.ndarray] = []
        paths, vantage = [], []
        todo = [(np.arange(len(x)), [])] if len(x) else []
        while todo:
            at, path = todo.pop()
            if len(at) <= leaf:
                y = full[at]
                vantage.append(int(at[_distances(y, y.mean(0)).argmin()]))  # a leaf has a vantage point in its middle too: the only near one for most queries
                self.leaves.append(at)
                paths.append(np.array([*path, len(vantage) - 1], np.int64))
                continue
            v, near, far = _split(full, at)
            vantage.append(v)
            todo += [(far, [*path, len(vantage) - 1]), (near, [*path, len(vantage) - 1])]
        self._points = x[vantage].astype(np.float64)
        self._paths = []
        for at, path in zip(self.leaves, paths):
            d = [_distances(full[at], full[vantage[i]]) for i in path]
            self._paths.append((path, np.array([y.min() for y in d]), np.array([y.max() for y in d])))

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The most and the least that a row of each leaf can score; a little more and less, as distances are rounded."""
        q = q.astype(np.float64)
        whole = (q * q).sum(1)[:, None] + self.m2
        slack = 2e-6 * np.sqrt(whole)
        d = np.sqrt(np.maximum(whole - 2 * (q @ self._points.T), 0))
        near, far = (np.empty((len(q), len(self.leaves))) for _ in range(2))
        for j, (path, least, most) in enumerate(self._paths):
            near[:, j] = np.maximum(d[:, path] - most, least - d[:, path]).max(1)
            far[:, j] = (d[:, path] + most).min(1)
        near = np.maximum(near - slack, 0)
        return (whole - near**2) / 2 * (1 + 1e-9) + 1, (whole - (far + slack) ** 2) / 2 - 1e-9 * whole - 1

    def search(self, q: np.ndarray, q_ids: np.ndarray, q_labels: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool, opened: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Scores (NONE where there are fewer) and ids of the k best of each window, ties to the smaller id.

        Window i belongs to query of[i] and holds scores from low[i] to high[i]; rows must have the
        query's label (``same``) or another, and another id. opened, if given, gets the pairs of
        window and leaf that were opened, and all of them.
        """
        best, ids = np.full((len(of), k), NONE), np.zeros((len(of), k), np.int64)
        if not self.leaves or not len(of):
            return best, ids
        top = max(1, q.shape[1]) * int(np.abs(q).max(initial=0)) * self.largest
        kind = np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64  # all of them exact
        most, least = self.bounds(q)
        key = np.minimum(most[of], high.astype(np.float64)[:, None])
        key[(most[of] < low[:, None]) | (least[of] > high[:, None])] = -np.inf
        exact, parts = q.astype(kind), {}
        count = 0

        def visit(j: int, who: np.ndarray) -> None:
            nonlocal count
            count += len(who)
            at = self.leaves[j]
            if j not in parts:
                parts[j] = self.x[at].astype(kind).T
            asked, back = np.unique(of[who], return_inverse=True)
            s = np.rint(exact[asked] @ parts[j]).astype(np.int64) if kind is not np.int64 else exact[asked] @ parts[j]
            out = ((q_labels[asked][:, None] == self.labels[at][None, :]) != same) | (q_ids[asked][:, None] == self.ids[at][None, :])
            s = np.where(out, NONE, s)[back]
            s[(s < np.maximum(low, best[:, -1])[who][:, None]) | (s > high[who][:, None])] = NONE
            some = np.flatnonzero((s > NONE).any(1))
            if not len(some):
                return
            rows = who[some]
            s = np.concatenate([best[rows], s[some]], 1)
            i = np.concatenate([ids[rows], np.broadcast_to(self.ids[at], (len(rows), len(at)))], 1)
            keep = np.lexsort((i, -1 - s))[:, :k]  # -1 - s falls as s rises, and always fits
            best[rows], ids[rows] = np.take_along_axis(s, keep, 1), np.take_along_axis(i, keep, 1)

        def open_(who: np.ndarray, j: np.ndarray | int) -> np.ndarray:
            return (key[who, j] > -np.inf) & (key[who, j] >= best[who, -1])  # an equal score may still win by its id

        n = min(TURNS, len(self.leaves))
        by = np.argsort(-key, axis=1, kind="stable")[:, :n]
        for turn in range(n):
            who = np.flatnonzero(open_(np.arange(len(of)), by[:, turn]))
            for j in np.unique(by[who, turn]).tolist():
                visit(j, who[by[who, turn] == j])
        left = key.copy()
        np.put_along_axis(left, by, -np.inf, 1)
        for j in np.argsort(-left.max(0), kind="stable").tolist():
            who = np.flatnonzero(left[:, j] > -np.inf)
            who = who[open_(who, j)]
            if len(who):
                visit(j, who)
        if opened is not None:
            opened += [count, key.size]
        return best, ids


class Cells:
    """The coarse tree: numbers of its leaves for any vectors, near ones alike."""

    def __init__(self, x: np.ndarray, m2: float, cells: int = CELLS):
        full, self.m2 = _augmented(x, m2)
        self.nodes: list[tuple[np.ndarray, float] | None] = [None] * (2 * cells)  # node i has 2i and 2i + 1 below it
        todo = [(1, np.arange(len(x)))]
        while todo:
            i, at = todo.pop()
            if i < cells and len(at) > 1:
                v, near, far = _split(full, at)
                self.nodes[i] = full[v], float((_distances(full[near], full[v]).max() + _distances(full[far], full[v]).min()) / 2)
                todo += [(2 * i, near), (2 * i + 1, far)]
        self.cells = cells

    def of(self, x: np.ndarray) -> np.ndarray:
        full, _ = _augmented(x, self.m2)
        node = np.ones(len(x), np.int64)
        for _ in range(self.cells.bit_length() - 1):
            for i in np.unique(node).tolist():
                at = np.flatnonzero(node == i)
                split = self.nodes[i]
                node[at] = 2 * i + (_distances(full[at], split[0]) > split[1] if split else 0)
        return node - self.cells


def _laid(rows: DataFrame, width: int) -> DataFrame:
    """rows (id, label, vec, anchor) with their group: neighbours in the coarse tree, cut into GROUP rows."""
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    m2 = rows.agg(F.max(square)).first()[0] or 0.0
    sample = rows.select("vec").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()["vec"]
    x = np.zeros((len(sample), width), np.int64)
    for i, v in enumerate(sample):
        x[i, : len(v)] = v
    tree = Cells(x, m2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.of(_matrix(b.column(2), width)), pa.int64())], names=["id", "label", "vec", "anchor", "cell"])

    routed = rows.select("id", "label", "vec", "anchor").mapInArrow(run, "id long, label long, vec array<int>, anchor boolean, cell long")
    order = ["cell", "id", F.xxhash64("vec")]
    laid = routed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    return stored(laid.select("id", "label", "vec", "anchor", F.shiftright("at", 33).alias("part"), F.expr(f"(at & {(1 << 33) - 1}) div {GROUP}").alias("nth")))


FOUND = "anchor_id long, window int, id long, score long"


def _search(laid: DataFrame, asked: DataFrame, k: int, same: bool, width: int) -> DataFrame:
    """FOUND within each group of ``laid``: the k best for each window of ``asked`` (id, label, vec, low, high, part, nth, slice)."""
    data = laid.select("part", "nth", "id", "label", "vec", F.array().cast("array<long>").alias("low"), F.array().cast("array<long>").alias("high"))
    slices = asked.select("part", "nth", "slice").distinct()
    data = data.join(slices, ["part", "nth"]).withColumn("asked", F.lit(False))
    rows = data.unionByName(asked.withColumn("asked", F.lit(True))).select("part", "nth", "slice", "asked", "id", "label", "vec", "low", "high")
    rows = rows.repartition("part", "nth", "slice").sortWithinPartitions("part", "nth", "slice", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, tree = None, [], None
        for b in batches:
            place = np.column_stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
            starts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1).tolist()]
            for a, z in zip(starts, [*starts[1:], len(place)]):
                if here != (group := tuple(place[a, :3])):
                    here, held, tree = group, [], None
                if not place[a, 3]:
                    held.append([_matrix(b.column(6).slice(a, z - a), width).astype(np.int32), *(b.column(i).slice(a, z - a).to_numpy() for i in (4, 5))])
                    continue
                if tree is None:
                    tree = VantageTree(*(np.concatenate(x) for x in zip(*held))) if held else VantageTree(np.zeros((0, width), np.int64), *[np.zeros(0, np.int64)] * 2)
                    held = []
                for c in range(a, z, CHUNK):
                    part = b.slice(c, min(CHUNK, z - c))
                    ids, labels, low, high = (part.column(i) for i in (4, 5, 7, 8))
                    sizes = np.diff(low.offsets.to_numpy())
                    of, number = np.repeat(np.arange(len(part)), sizes), np.concatenate([np.arange(n) for n in sizes]) if len(sizes) else sizes
                    q = _matrix(part.column(6), width)
                    scores, found = tree.search(q, ids.to_numpy(), labels.to_numpy(), of, low.flatten().to_numpy(), high.flatten().to_numpy(), k, same)
                    has = scores > NONE
                    w = np.nonzero(has)[0]
                    if len(w):
                        yield pa.RecordBatch.from_arrays([pa.array(ids.to_numpy()[of[w]]), pa.array(number[w].astype(np.int32)), pa.array(found[has]), pa.array(scores[has])], names=["anchor_id", "window", "id", "score"])

    return rows.mapInArrow(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """FOUND and rank (from 1) of the k best of each window."""
    rank = F.row_number().over(W.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _k_best(laid: DataFrame, anchors: DataFrame, k: int, same: bool, width: int, groups: tuple[int, int], slices: int) -> DataFrame:
    """FOUND and rank of the k best for each window of anchors (id, label, vec, low, high, part, nth) in all groups: the anchor's own, then the others above what that gave."""
    number = F.pmod(F.xxhash64("id"), F.lit(slices))
    own = stored(_best(_search(laid, anchors.withColumn("slice", number), k, same, width), k))
    kth = own.filter(F.col("rank") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth")).withColumnRenamed("anchor_id", "id")
    raised = F.transform("low", lambda x, i: F.greatest(x, F.element_at("kth", i.cast("int"))))
    asked = anchors.join(kth, "id", "left").withColumn("low", F.when(F.col("kth").isNull(), F.col("low")).otherwise(raised)).drop("kth")
    every = asked.withColumnsRenamed({"part": "own_part", "nth": "own_nth"}).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups[0])))).withColumn("nth", F.explode(F.sequence(F.lit(0), F.lit(groups[1]))))
    others = every.filter((F.col("part") != F.col("own_part")) | (F.col("nth") != F.col("own_nth"))).drop("own_part", "own_nth").withColumns({"part": F.col("part").cast("long"), "nth": F.col("nth").cast("long")})
    return _best(own.drop("rank").unionByName(_search(laid, others.withColumn("slice", number), k, same, width)), k)


def mine(vectors: DataFrame, is_anchor: Column, label: Column, vec: str = "embedding", vec_id: str = "vec_id", scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Scores are inner products of floor(scale * x). An anchor's positives are its best other rows
    of the same label; for each of them its negatives are the best rows of other labels whose
    score is from ``low`` to ``high`` hundredths of the positive's. Ties go to the smaller id.
    Rows with a null id, label or vector, or null or non-finite components, take no part, nor do
    those with an integer component of 2 ** 26 or more. Empty vectors score 0; missing components
    of shorter vectors count as 0. Ids are taken to be unique: rows that repeat one are not each
    other's partners. Fewer rows than asked for give all of them, an empty table none.
    """
    spark = reachable(vectors.sparkSession)
    c = F.col(vec)
    whole = F.transform(c, lambda x: F.floor(x.cast("double") * scale))
    fits = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < F.lit(float(TOO_LARGE))))
    good = vectors.filter(c.isNotNull() & F.col(vec_id).isNotNull()).filter(fits)
    rows = good.select(F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), whole.cast("array<int>").alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("anchor")).filter(F.col("label").isNotNull())
    width = max(1, rows.agg(F.max(F.size("vec"))).first()[0] or 0)
    laid = _laid(rows, width)
    last = laid.agg(F.max("part"), F.max("nth"), F.count_if("anchor")).first()
    groups, slices = (last[0] or 0, last[1] or 0), 1 + last[2] // SLICE
    anchors = laid.filter("anchor").select("id", "label", "vec", "part", "nth").dropDuplicates(["id", "label", "vec"])
    one = lambda x: F.array(F.lit(x).cast("long"))
    near = _k_best(laid, anchors.withColumns({"low": one(NONE + 1), "high": one(MOST)}), positives, True, width, groups, slices)
    near = stored(near.select("anchor_id", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # low * s <= 100 * n <= high * s in whole numbers; no n fits where s is negative.
    windows = near.groupBy(F.col("anchor_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("window", "positive_score"))).alias("w"))
    decimal = lambda x: x["positive_score"].cast("decimal(20,0)")
    edge = lambda f, share: F.transform("w", lambda x: f(decimal(x) * share / 100).cast("long"))
    asked = anchors.join(windows, "id").withColumns({"low": edge(F.ceil, low), "high": edge(F.floor, high)}).drop("w")
    far = _k_best(laid, asked, negatives, False, width, groups, slices)
    out = far.select("anchor_id", "window", F.col("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(near, ["anchor_id", "window"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table, F.col("vec_id") % 50 == 0, label)


SQL = """WITH v AS (SELECT CAST(vec_id AS BIGINT) AS id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, CAST(list_dot_product(a.vec, b.vec) AS BIGINT) AS score FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= 3"""
