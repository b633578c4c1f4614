"""Near-duplicate documents by an exact Jaccard join on word shingles, over a token-group matrix.

Documents with equal sets are one node. Of each node's shingles, in an order that puts frequent
ones last, a prefix is kept of which any partner must share a certain number; prefix shingles
that no other text can have (a sketch of fixed size tells) are dropped, and with them most
documents. Candidates that agree on a key, as the least shingle hash, and have similar sizes are
compared with the first of them; those that similar pairs connect make groups, the others of the
same key make groups of their own, each of a bounded number of members and shingles. Only
candidates' whole sets are ever stored.

The matrix has a row for each prefix shingle and group. Two groups of similar sizes qualify if
they share enough rows, and if not all their members are known to be linked already. A group's
record holds the union of its members' shingles and where each member's lie in it; if the unions
of a qualifying pair share enough, the pair is opened and its members are compared at once, as a
product of two 0-1 matrices. Links leave as stars, so large groups of copies cost no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha1

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.llm import sketch
from loamgraph.llm._common import documents, filter_bits, forget, in_filter, modest_batches, stored
from loamgraph.llm.components import components, stars
from loamgraph.llm.shingles import mix, shingle_sets, signature

#: Members of a group, on average, and shingles of a group's members (unless one has more).
GROUP, GROUP_SHINGLES = 96, 1 << 16
#: At most so many shingles count as frequent: the most frequent ones that occur 8 times or more.
FREQUENT = 1 << 20
#: Bits of the filter that keeps the sets of candidates.
FILTER_BITS = 1 << 26


def _need(n: int, percent: int) -> int:
    """The least overlap of a set of n with any partner."""
    return -(-percent * n // 100)


def _spare(n: int) -> int:
    """Prefix shingles beyond the one that partners must share; so many more they must share as well."""
    return n // 16


def _least(n: int, percent: int) -> int:
    """What a node's partner shares with its prefix at least: the partner may be smaller, and prefixes hold 32 bits of a shingle, of which two in a prefix may agree."""
    return max(1, _spare(_need(n, percent)) * 63 // 64 - 2)


def _bucket(n: int, percent: int) -> int:
    """Sizes of a pair lie in the same bucket or in neighbouring ones; buckets are below 2 ** 16."""
    return int(math.log(n) / (math.log(100 / percent) * 1.000001)) if percent < 100 else n


def _frequent(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, sorted, and their counts, which only order the shingles: any order gives the same links."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def part() -> pa.RecordBatch:
            x = np.concatenate(held) if held else np.zeros(0, np.uint64)
            x.sort()
            edge = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])) if len(x) else np.zeros(1, np.int64)
            n = np.diff(edge)
            keep = n > 1
            held.clear()
            return pa.RecordBatch.from_pydict({"token": x[edge[:-1]][keep].view(np.int64), "n": n[keep].astype(np.int64)})

        for b in batches:
            held += shingle_sets(b.column(0).to_pylist(), words)
            if sum(map(len, held)) > 3_000_000:
                yield part()
        yield part()

    counts = stored(docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter("n >= 8"))
    # As many rows as there are different counts: few, since n of them need n * n / 2 shingles.
    least, room = 8, FREQUENT
    for r in sorted(counts.groupBy("n").agg(F.count("*").alias("k")).collect(), reverse=True):
        room -= r.k
        if room < 0:
            least = r.n + 1
            break
    got = counts.filter(F.col("n") >= least).select("token", "n").toArrow()
    forget(counts)
    token, n = got["token"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


def _prefix(x: np.ndarray, percent: int, token: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The prefix of a set, given the frequent shingles and their counts."""
    p = min(len(x), len(x) - _need(len(x), percent) + 1 + _spare(len(x))) if len(x) else 0
    if not len(token) or not p:
        return x[:p]
    at = np.minimum(np.searchsorted(token, x), len(token) - 1)
    rank = np.where(token[at] == x, often[at], 0)
    rare = np.flatnonzero(rank == 0)
    return x[rare[:p]] if len(rare) >= p else x[np.argsort(rank, kind="stable")[:p]]


def _rows(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """rid (a number of the row), doc_id, n, s1, s2 (the set's signature); of sets that may have a partner also least, bucket, first (the least shingle) and prefix (32 bits of each shingle of it that others may have)."""
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(_frequent(docs, words))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        seen: set[str] = set()
        for b in batches:
            if len(seen) > 200_000:
                seen.clear()
            texts = [x for x in b.column(0).to_pylist() if x]
            keys = [sha1(x.encode("utf-8", "surrogatepass")).digest() for x in texts]
            new = [x for k, x in dict(zip(keys, texts)).items() if k not in seen]
            seen.update(keys)
            for x in shingle_sets(new, words):
                if len(x):
                    yield _prefix(x, percent, *order.value)

    sent = docs.select("text").mapInArrow(lambda batches: sketch.send((0, x) for x in prefixes(batches)), sketch.SCHEMA)
    shared = spark.sparkContext.broadcast(sketch.frequent(sent, (0, 2))[0])
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("least", pa.int64()), ("bucket", pa.int64()), ("first", pa.int64()), ("prefix", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rid = TaskContext.get().partitionId() << 40
        for b in batches:
            out = []
            for d, x in zip(b.column(0).to_pylist(), shingle_sets(b.column(1).to_pylist(), words)):
                row = [rid, d, len(x), *signature(x), None, None, None, None]
                rid += 1
                if len(x) and d is not None:
                    p = _prefix(x, percent, *order.value)
                    p = p[sketch.has(shared.value, p)]
                    if len(p) >= (least := _least(len(x), percent)):
                        row[5:] = [least, _bucket(len(x), percent), int(x[0].view(np.int64)), np.unique((p >> np.uint64(32)).astype(np.uint32)).view(np.int32)]
                out.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return stored(docs.mapInArrow(run, "rid long, doc_id long, n long, s1 long, s2 long, least long, bucket long, first long, prefix array<int>"))


def _meeting(nodes: DataFrame) -> DataFrame:
    """Those nodes that may share enough of their prefix with another of a similar size, and these shingles of their prefix."""
    spark = nodes.sparkSession

    def cells(bucket: int, prefix: np.ndarray) -> np.ndarray:
        """A shingle meets others of the next bucket in its own cell, others of the bucket before in that one's."""
        x = prefix.view(np.uint32).astype(np.uint64) << np.uint64(32)
        return mix(np.stack([x + np.uint64(bucket + 1), x + np.uint64(bucket)]))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            for k, p in zip(b.column(0).to_pylist(), b.column(1)):
                yield cells(k, p.values.to_numpy()).ravel()

    sent = nodes.select("bucket", "prefix").mapInArrow(lambda batches: sketch.send((0, x) for x in keys(batches)), sketch.SCHEMA)
    shared = spark.sparkContext.broadcast(sketch.frequent(sent, (0, 2))[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, left = [], []
            for least, k, p in zip(b.column("least").to_pylist(), b.column("bucket").to_pylist(), b.column("prefix")):
                p = p.values.to_numpy()
                p = p[sketch.has(shared.value, cells(k, p).ravel()).reshape(2, -1).any(0)]
                keep.append(len(p) >= least)
                if keep[-1]:
                    left.append(p)
            b = b.filter(pa.array(keep, pa.bool_()))
            yield b.set_column(b.schema.get_field_index("prefix"), "prefix", pa.array(left, pa.list_(pa.int32())))

    return stored(nodes.mapInArrow(run, nodes.schema))


def _with_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """These rows of (node, s1, s2, ...) with their shingles: a filter of fixed size spares most other documents the work."""
    spark = docs.sparkSession
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bits = spark.sparkContext.broadcast(filter_bits(nodes.select(slot("node").alias("h")), FILTER_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(in_filter(bits.value, b.column(2).to_numpy())))
            if b.num_rows:
                sets = shingle_sets(b.column(1).to_pylist(), words)
                signs = [signature(x) for x in sets]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([s[k] for s in signs], pa.int64()) for k in (0, 1)), pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "s1", "s2", "shingles"])

    found = docs.filter("doc_id IS NOT NULL").select("doc_id", "text", slot("doc_id").alias("h")).mapInArrow(run, "node long, s1 long, s2 long, shingles binary")
    return nodes.join(found, ["node", "s1", "s2"])


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _least_hash(salt: int) -> Column:
    """The least of the prefix in an order of its own: nearly equal prefixes mostly agree on it."""
    return F.array_min(F.transform("prefix", lambda x: F.xxhash64(F.lit(salt), x)))


def _near_first(docs: DataFrame, cand: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, centre), similar ones only: candidates with the first node of each of their keys that another has too.

    The keys: the least shingle, and the least ones of the prefix in two other orders, as the least
    shingle of a near copy may be one that no other text has; each with a range of sizes, and
    the ranges overlap. Many agree on a key by chance; the whole sets are fetched only of pairs
    that share as much of their prefixes as similar ones must.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok, pa.bool_())), b.column(1).filter(pa.array(ok, pa.bool_()))], names=["node", "centre"])

    half = lambda c: F.floor(c / 2)
    keys = F.array(F.xxhash64(F.lit(0), "first", "bucket"), F.xxhash64(F.lit(1), _least_hash(1), half(F.col("bucket"))), F.xxhash64(F.lit(2), _least_hash(2), half(F.col("bucket") + 1)))
    keyed = stored(cand.select("node", F.explode(keys).alias("key")))
    centres = keyed.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("k")).filter("k > 1").select("key", "centre")
    met = keyed.join(centres, "key").filter("node <> centre").select("node", "centre").distinct()
    short = cand.select("node", "least", "bucket", "prefix")
    met = met.join(short, "node").join(short.toDF("centre", "least2", "bucket2", "prefix2"), "centre")
    shared = F.size(F.array_intersect("prefix", "prefix2")) >= F.greatest("least", "least2")
    pairs = stored(met.filter(shared & (F.abs(F.col("bucket") - F.col("bucket2")) <= 1)).select("node", "centre"))
    wanted = pairs.select(F.explode(F.array("node", "centre")).alias("node")).distinct()
    sets = stored(_with_sets(docs, cand.select("node", "s1", "s2").join(wanted, "node", "left_semi"), words).select("node", "shingles"))
    out = pairs.join(sets.withColumnRenamed("shingles", "x"), "node").join(sets.select(F.col("node").alias("centre"), F.col("shingles").alias("y")), "centre")
    out = stored(out.select("node", "centre", "x", "y").mapInArrow(run, "node long, centre long").distinct())
    forget(keyed, pairs, sets)
    return out


def _groups(cand: DataFrame, first: DataFrame) -> DataFrame:
    """(node, s1, s2, part, n, least, bucket, prefix, group): candidates that similar pairs ``first`` connect are one part and lie in groups of it; the others, each a part, are grouped by a key of their prefix."""
    parts = components(first, "node", "centre").withColumnRenamed("component", "part")
    placed = cand.select("node", "s1", "s2", "n", "least", "bucket", "prefix").join(parts, "node", "left")
    key = F.when(F.col("part").isNotNull(), F.xxhash64(F.lit(1), "part")).otherwise(F.xxhash64(F.lit(2), _least_hash(1), "bucket"))
    placed = stored(placed.select("node", "s1", "s2", F.coalesce("part", "node").alias("part"), "n", "least", "bucket", "prefix", key.alias("key")))
    sizes = placed.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("n") / GROUP_SHINGLES)).alias("split"))
    out = stored(placed.join(sizes, "key").withColumn("group", F.xxhash64("key", "bucket", F.pmod(F.xxhash64("node"), F.col("split")))).drop("key", "split"))
    forget(placed)
    return out


def _matrix(grouped: DataFrame) -> DataFrame:
    """(cell, bucket, group, pure, least, k): a row for each prefix shingle and group; of groups of one part, that part."""
    cell = F.shiftleft(F.col("token").cast("long"), 16) + F.col("bucket")
    matrix = grouped.select("group", "part", "least", "bucket", F.explode("prefix").alias("token")).select(cell.alias("cell"), "bucket", "group", "part", "least").groupBy("cell", "bucket", "group")
    return stored(matrix.agg(F.when(F.min("part") == F.max("part"), F.min("part")).alias("pure"), F.min("least").cast("int").alias("least"), F.count("*").cast("int").alias("k")))


def _meetings(matrix: DataFrame) -> DataFrame:
    """Rows of the matrix that two groups share, if not all their members are known to be linked already."""
    left = matrix.select("cell", F.col("group").alias("g1"), F.col("pure").alias("pure1"), F.col("least").alias("least1"))
    right = matrix.select("cell", F.lit(False).alias("next"), F.col("group").alias("g2"), F.col("pure").alias("pure2"), F.col("least").alias("least2"))
    right = right.unionByName(right.select(F.col("cell") - 1, F.lit(True), "g2", "pure2", "least2").toDF(*right.columns))
    return left.join(right, "cell").filter("(next OR g1 < g2) AND NOT coalesce(pure1 = pure2, false)")


_RECORD = "group long, nodes binary, parts binary, sizes binary, union binary, places binary"


def _records(rows: DataFrame) -> DataFrame:
    """A record for each group of (group, part, node, shingles) rows: the members, their parts and sizes, the union of their shingles, and the members' places in it in turn."""
    schema = pa.schema([("group", pa.int64()), *((c, pa.binary()) for c in ("nodes", "parts", "sizes", "union", "places"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def record() -> pa.RecordBatch:
            sets = [np.frombuffer(r[3], np.uint64) for r in held]
            union, places = np.unique(np.concatenate(sets), return_inverse=True)
            columns = [held[0][0], np.array([r[2] for r in held], "<i8"), np.array([r[1] for r in held], "<i8"), np.array([len(x) for x in sets], "<i8"), union, places.astype("<u4")]
            return pa.RecordBatch.from_arrays([pa.array([x if i == 0 else x.tobytes()], f.type) for i, (x, f) in enumerate(zip(columns, schema))], schema=schema)

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if held and held[0][0] != r[0]:
                    yield record()
                    held.clear()
                held.append(r)
        if held:
            yield record()

    return rows.select("group", "part", "node", "shingles").repartition("group").sortWithinPartitions("group", "node").mapInArrow(run, _RECORD)


class _Group:
    def __init__(self, nodes: bytes, parts: bytes, sizes: bytes, union: bytes, places: bytes):
        self.nodes, self.parts, self.n = (np.frombuffer(x, "<i8") for x in (nodes, parts, sizes))
        self.union, self.places = np.frombuffer(union, np.uint64), np.frombuffer(places, "<u4")
        self.member = np.repeat(np.arange(len(self.n)), self.n)

    def matrix(self, column: np.ndarray, width: int) -> np.ndarray:
        """Members by columns, given the column of each shingle of the union (-1: none of these)."""
        out = np.zeros((len(self.n), width), np.float32)
        at = column[self.places]
        has = at >= 0
        out[self.member[has], at[has]] = 1
        return out


def _open(g: _Group, h: _Group, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between members of two groups that are not of one part yet, as stars."""
    _, x, y = np.intersect1d(g.union, h.union, assume_unique=True, return_indices=True)
    need = percent * (int(g.n.min()) + int(h.n.min()))
    none = np.zeros(0, np.int64)
    if (100 + percent) * len(x) < need:  # of sets of n and m, at least percent * (n + m) / (100 + percent) are common
        return none, none
    both = np.zeros((len(g.n), len(h.n)), np.float32)
    for a in range(0, len(x), 8192):  # sums of ones are exact up to 2 ** 24
        columns = []
        for group, at in ((g, x), (h, y)):
            column = np.full(len(group.union), -1, np.int64)
            column[at[a : a + 8192]] = np.arange(len(at[a : a + 8192]))
            columns.append(group.matrix(column, len(at[a : a + 8192])))
        both += columns[0] @ columns[1].T
    both = both.astype(np.int64)
    i, j = np.nonzero((100 * both >= percent * (g.n[:, None] + h.n[None, :] - both)) & (g.parts[:, None] != h.parts[None, :]) & (g.nodes[:, None] != h.nodes[None, :]))
    nodes = np.concatenate([g.nodes, h.nodes])
    root = stars(i, j + len(g.n), len(nodes))
    at = np.flatnonzero(root != np.arange(len(root)))
    return nodes[at], nodes[root[at]]


def _open_pairs(pairs: DataFrame, records: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) found in the pairs (g1, g2) of groups."""
    side = lambda k: records.select(*[F.col(c).alias(f"g{k}" if c == "group" else f"{c}{k}") for c in records.columns])
    columns = [f"{c}{k}" for k in (1, 2) for c in ("nodes", "parts", "sizes", "union", "places")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [_open(_Group(*r[:5]), _Group(*r[5:]), percent) for r in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_pydict({k: pa.array(np.concatenate([x[i] for x in out]) if out else [], pa.int64()) for i, k in enumerate(("a", "b"))})

    return pairs.join(side(1), "g1").join(side(2), "g2").select(*columns).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of every row.

    Two documents link if their sets of word shingles have a Jaccard similarity of at least
    ``percent``/100. A text of fewer words is one shingle; one without words, like a null
    text, has an empty set and links with nothing. A null doc_id links with nothing and has a
    null component. Rows that share a doc_id are one document, with the links of all its texts.
    """
    spark = docs.sparkSession
    modest_batches(spark, 500)
    docs = documents(docs, text, doc_id)
    rows = _rows(docs, words, percent)
    known = rows.filter("n > 0 AND doc_id IS NOT NULL")
    classes = stored(known.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "rid")).alias("r")).select("s1", "s2", F.col("r.doc_id").alias("node"), F.col("r.rid").alias("rid")))
    narrow = rows.filter("least IS NOT NULL").select("rid", "s1", "s2", "n", "least", "bucket", "first", "prefix")
    cand = _meeting(narrow.join(classes.select("rid", "node"), "rid").select("node", "s1", "s2", "n", "least", "bucket", "first", "prefix"))
    # Those that met others only which went themselves go too.
    cand, before = _meeting(cand), cand
    forget(before)
    first = _near_first(docs, cand, words, percent)
    grouped = _groups(cand, first)
    forget(cand)
    matrix = _matrix(grouped)
    met = _meetings(matrix)
    pairs = met.groupBy("g1", "g2").agg(F.count("*").alias("k"), F.min("least1").alias("least1"), F.min("least2").alias("least2")).filter("k >= greatest(least1, least2)").select("g1", "g2")
    own = matrix.filter("k > 1 AND pure IS NULL").groupBy("group").agg(F.count("*").alias("k"), F.min("least").alias("least")).filter("k >= least").select(F.col("group").alias("g1"), F.col("group").alias("g2"))
    pairs = stored(pairs.unionByName(own))
    forget(matrix)
    wanted = pairs.select(F.explode(F.array("g1", "g2")).alias("group")).distinct()
    members = stored(grouped.select("node", "s1", "s2", "group", "part").join(wanted, "group", "left_semi"))
    forget(grouped)
    records = stored(_records(_with_sets(docs, members, words)))
    forget(members)
    # Rows that share a doc_id and not their sets: the document is linked with the first node of each set.
    several = known.groupBy("doc_id").agg(F.min("s1").alias("x"), F.max("s1").alias("y"), F.min("s2").alias("x2"), F.max("s2").alias("y2")).filter("x < y OR x2 < y2").select("doc_id")
    same = known.select("doc_id", "s1", "s2").join(several, "doc_id").join(classes, ["s1", "s2"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    links = _open_pairs(pairs, records, percent).unionByName(first.select(F.col("node").alias("a"), F.col("centre").alias("b"))).unionByName(same)
    found = components(links)
    forget(pairs, records, first)
    named = classes.join(found, "node", "left").select("s1", "s2", F.coalesce("component", "node").alias("component_id"))
    alone = rows.filter("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return known.join(named, ["s1", "s2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, percent=85)
