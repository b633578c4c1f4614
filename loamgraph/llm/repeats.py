"""Removal of byte strings that occur again, by a run-length index.

A string of a given length is repeated if it starts anywhere else too. Anchors are chosen from
the content alone: a place whose ``K``-byte hash is the least of some stretch of the shortest
length asked for. Every such string holds the anchor of one stretch, so equal strings hold
equal anchors at equal places; only anchors that may occur twice matter (a sketch of fixed
size tells), and around each the bytes that such strings can take in make a slice.

Equal slices are one, sent once by each task. The slices of an anchor are indexed together by
their Burrows-Wheeler transform, aligned at the anchor and built column by column from the
right: the slices' order by the suffix that starts in a column follows from the next column's
by a stable partition on one byte. Inside a run of equal bytes neighbours stay neighbours and
their common prefix grows by one; it is computed anew only at run ends. The matching statistic
of a slice at a column, the larger common prefix with its neighbours, streams out with the
columns, and starts where it reaches a length are marked. What is found goes back to all
places of a slice by an equi join.

An anchor in ``HOT`` places or more is not gathered: the strings around it are counted by their
128-bit hashes, partly in each task, so that one passage in a large part of all texts is no
more work for one task than any other. A text that has an equal copy is covered as a whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.llm import sketch
from loamgraph.llm._common import filter_bits, in_filter, modest_batches, release, stored
from loamgraph.llm.shingles import mix

#: Bytes of the strings that op9_repeats removes, and of those that the pipeline's stage does: the
#: latter are shorter than any passage of 50 words.
LENGTH, PASSAGE = 400, 240
K = 32
#: From so many places on an anchor's strings are counted by hash.
HOT = 20_000
FILTER_BITS = 1 << 26
#: Texts are worked on in blocks of about so many bytes; entries of the memo of slices of a task.
BLOCK, MEMO = 1 << 18, 400_000
_U, _V = np.uint64, np.uint32


@functools.lru_cache(maxsize=1)
def _values() -> np.ndarray:
    return (mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) >> _U(32)).astype(np.uint32)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the K bytes from each place on; K is a power of two."""
    h, w, c = _values()[data], 1, 0x9E3779B1
    while w < K:
        h = h[:-w] * _V(c) + h[w:]
        w, c = 2 * w, c * c & 0xFFFFFFFF
    h ^= h >> _V(16)
    h *= _V(0x85EBCA6B)
    h ^= h >> _V(13)
    h *= _V(0xC2B2AE35)
    return h ^ (h >> _V(16))


def _sliding(x: np.ndarray, w: int, of: np.ufunc) -> np.ndarray:
    """of.reduce over x[s : s + w] for each s, by doubling."""
    out, n, have = x, len(x) - w + 1, 1
    while 2 * have <= w:
        out = of(out[:-have], out[have:])
        have *= 2
    return of(out[:n], out[w - have : w - have + n])


def _identity(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of the K bytes at these places."""
    words = np.ascontiguousarray(data[at[:, None] + np.arange(K)]).view(np.uint64)
    h = np.full(len(at), 0x243F6A8885A308D3, np.uint64)
    for j in range(words.shape[1]):
        h = mix(h * _U(0xD6E8FEB86659FD93) + words[:, j])
    return h


class Anchored:
    """Some bytes of texts with their anchors: places (in ``data``) and hashes, and the first places of the anchored stretches by least value."""

    def __init__(self, pieces: list[tuple[int, bytes, int, int, int]], length: int):
        #: (text number, bytes, place of the bytes in the text, first and last place of the text whose anchors count)
        self.pieces = pieces
        self.data = np.frombuffer(b"".join(p[1] for p in pieces), np.uint8)
        self.edge = np.cumsum([0, *(len(p[1]) for p in pieces)])
        span = length - K + 1
        self.h = h = _gram_hashes(self.data)
        least = _sliding(h, span, np.minimum)  # of the stretch from each place on
        for end in self.edge[1:].tolist():
            least[max(0, end - length + 1) : end] = 0  # no stretch crosses the end of a text
        self.least = least
        edge = np.zeros(span - 1, np.uint32)
        at = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), span, np.maximum) == h)
        owner = np.searchsorted(self.edge, at, side="right") - 1
        base = np.array([p[2] for p in pieces])[owner] - self.edge[owner]
        first, last = (np.array([p[k] for p in pieces])[owner] for k in (3, 4))
        own = (at + base >= first) & (at + base < last) & (at + K <= self.edge[owner + 1])
        self.at, self.owner, self.base = at[own], owner[own], base[own]
        self.hash = _identity(self.data, self.at)


def anchored(texts: list[bytes], length: int) -> Iterator[Anchored]:
    """All texts of at least ``length`` bytes, block by block; a long one in pieces that overlap, so that memory goes with the block."""
    held: list[tuple[int, bytes, int, int, int]] = []
    size = 0
    for i, x in enumerate(texts):
        if len(x) < length:
            continue
        for a in range(0, len(x), BLOCK):
            b = min(a + BLOCK, len(x))
            lo, hi = max(0, a - length), min(len(x), b + length)
            if held and size + hi - lo > BLOCK + 2 * length:
                yield Anchored(held, length)
                held, size = [], 0
            held.append((i, x[lo:hi], lo, a, b))
            size += hi - lo
    if held:
        yield Anchored(held, length)


def repeated_runs(slices: list[bytes], before: np.ndarray, group: np.ndarray, lengths: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length (by its number) slices and what strings found in another slice of their group too cover of them, as [start, end) relative to the anchor.

    A slice has ``before`` bytes before the anchor, then the anchor and on. group: non-decreasing
    numbers from 0, fewer than 65536. Starts stream in with the columns and are joined into runs
    at once, so memory goes with the slices, not with the starts.
    """
    lead, top = lengths[0] - K, lengths[-1]
    m, width = len(slices), lengths[0] - K + lengths[-1]
    grid = np.zeros((width, m), np.uint16)  # bytes plus one, 0 where a text has ended
    for i, (s, b) in enumerate(zip(slices, before.tolist())):
        grid[lead - b : lead - b + len(s), i] = np.frombuffer(s, np.uint8)
        grid[lead - b : lead - b + len(s), i] += 1
    after = np.array([len(s) for s in slices]) - before
    order = np.arange(m)
    place = group.astype(np.uint16)  # groups keep their places in the order
    within = place[1:] == place[:-1]
    several = len(place) and place[-1] > 0
    common = np.zeros(m + 1, np.int32)  # of a slice in order with the one before it
    # The run that each slice has open, as its first start and its end; columns come from the right.
    first, end = (np.full((len(lengths), m), v, np.int64) for v in (1 << 20, -(1 << 20)))
    for j in range(width - 1, -1, -1):
        c = grid[j].take(order)
        by = np.argsort(c, kind="stable")  # 16-bit keys sort by radix
        if several:
            by = by[np.argsort(place[by], kind="stable")]
        c = c[by]
        at = np.flatnonzero((c[1:] == c[:-1]) & within) + 1
        grown = np.zeros(m + 1, np.int32)
        if len(at):
            joined, prior = by[at], by[at - 1]
            value = common[joined]  # inside a run: neighbours before, neighbours now
            ends = np.flatnonzero(joined != prior + 1)  # run ends
            if len(ends):
                pairs = np.stack([prior[ends] + 1, joined[ends] + 1], 1).ravel()
                value[ends] = np.minimum.reduceat(common, pairs)[::2]
            grown[at] = np.minimum(value + 1, top)
        common, order = grown, order[by]
        if j <= lead and len(at):
            best = np.maximum(common[:m], common[1:])
            start = j - lead
            for k, length in enumerate(lengths):
                hit = order[best >= length]
                hit = hit[(start >= -before[hit]) & (start + length <= after[hit])]
                new = hit[first[k, hit] > (1 << 19)]
                end[k, new] = start + length
                first[k, hit] = start
    for k in range(len(lengths)):
        # All strings of a slice hold its anchor, so what they cover is one run.
        done = np.flatnonzero(end[k] > first[k])
        yield k, done, first[k, done], end[k, done]


def _window_hashes(x: bytes, starts: np.ndarray, length: int) -> np.ndarray:
    """128-bit hashes, as rows of two 64-bit ones, of the strings of ``length`` bytes that start at these places."""
    data = np.frombuffer(x, np.uint8)
    out = []
    for base in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95):
        values = mix(np.arange(1, 257, dtype=np.uint64) * _U(base))
        up, down = (np.full(len(data) + 1, b, np.uint64) for b in (base, pow(base, -1, 1 << 64)))
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * up[:-1], out=total[1:])
        out.append(mix((total[starts + length] - total[starts]) * down[starts]))
    return np.stack(out, 1).view(np.int64)


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _digests(slices: list[tuple[bytes, int]]) -> list[bytes]:
    import xxhash

    return [xxhash.xxh3_128_digest(s, before) for s, before in slices]


def _slot(digest: bytes) -> int:
    return int.from_bytes(digest[:4], "little") % FILTER_BITS


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


_SLICES = pa.schema([("h", pa.int64()), ("s", pa.binary()), ("n", pa.int32()), ("before", pa.int32()), ("slice", pa.binary())])
_PLACES = pa.schema([("s", pa.binary()), ("t1", pa.int64()), ("t2", pa.int64()), ("p", pa.int64()), ("q", pa.int64())])
_FOUND = pa.schema([("s", pa.binary()), ("slot", pa.int64()), ("level", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])
_WINDOWS = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("level", pa.int32()), ("t1", pa.int64()), ("t2", pa.int64()), ("a", pa.int64())])


def _spans(docs: DataFrame, lengths: tuple[int, ...], text: str) -> DataFrame:
    """(t1, t2, level, a, b): byte ranges [a, b) of distinct texts that strings of the length of this number cover, in no set order; they may overlap.

    t1 and t2 are the text's hashes, as ``keys`` gives them. A null text counts as empty.
    """
    spark = docs.sparkSession
    modest_batches(spark, 500)
    least, top = lengths[0], lengths[-1]
    lead, hot_from = least - K, HOT
    rows = docs.select(*keys(text), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("bytes"))
    rows = rows.filter(F.length("bytes") >= least)
    copies = rows.groupBy("t1", "t2").agg(F.count("*").alias("copies"), F.max(F.length("bytes")).cast("long").alias("b")).filter("copies > 1")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, Anchored]]:
        """Distinct texts of a task as (t1, t2, bytes) with their anchors."""
        release()
        seen: set[tuple[int, int]] = set()
        for b in batches:
            if len(seen) > MEMO:
                seen.clear()
            new = []
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if r[:2] not in seen:
                    seen.add(r[:2])
                    new.append(r)
            for some in anchored([r[2] for r in new], least):
                yield new, some

    sent = rows.mapInArrow(lambda batches: sketch.send((0, x.hash) for _, x in blocks(batches)), sketch.SCHEMA)
    bits, hot_bits = sketch.frequent(sent, (0, 2), (0, hot_from))
    any_hot = bool(hot_bits.bits.any())
    twice = spark.sparkContext.broadcast(bits)
    hot = spark.sparkContext.broadcast(hot_bits) if any_hot else None

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, Anchored, np.ndarray, list[tuple[bytes, int]]]]:
        """With each block the anchors that may occur twice and are not hot, and their slices and the bytes before the anchor."""
        for texts, x in blocks(batches):
            keep = sketch.has(twice.value, x.hash)
            if any_hot:
                keep &= ~sketch.has(hot.value, x.hash)
            keep = np.flatnonzero(keep)
            owner = [x.pieces[o][0] for o in x.owner[keep].tolist()]
            places = (x.at[keep] + x.base[keep]).tolist()
            slices = [(texts[o][2][max(0, p - lead) : p + top], min(p, lead)) for o, p in zip(owner, places)]
            yield [(*texts[o][:2], p) for o, p in zip(owner, places)], x, x.hash[keep].view(np.int64), slices

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for _, _, h, slices in around(batches):
            if len(known) > MEMO:
                known.clear()
            out: list[tuple] = []
            for v, (s, before), d in zip(h.tolist(), slices, _digests(slices)):
                n = known.get(d, 0)
                if n < 2:  # the second is sent to tell that there are two
                    known[d] = n + 1
                    out.append((v, d, 1, before, None if n else s))
            yield _batch(out, _SLICES)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[list] = []  # [h, digest, count, before, slice] of whole groups, distinct
        groups = 0

        def done() -> pa.RecordBatch:
            out: list[tuple] = []
            h = np.array([r[0] for r in held], np.int64)
            edge = np.concatenate([[True], h[1:] != h[:-1], [True]]).nonzero()[0]
            size = np.repeat(np.diff(edge), np.diff(edge))
            for r in held:
                if r[2] > 1:
                    out += [(r[1], _slot(r[1]), k, -r[3], len(r[4]) - r[3]) for k, n in enumerate(lengths) if len(r[4]) >= n]
            rest = [r for r, n in zip(held, size.tolist()) if n > 1]
            h = h[size > 1]
            if rest:
                group = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]]))
                single = np.array([r[2] < 2 for r in rest])
                for k, at, a, b in repeated_runs([r[4] for r in rest], np.array([r[3] for r in rest]), group, lengths):
                    out += [(rest[i][1], _slot(rest[i][1]), k, s, e) for i, s, e, one in zip(at.tolist(), a.tolist(), b.tolist(), single[at].tolist()) if one]
            return _batch(out, _FOUND)

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if held and held[-1][1] == r[1]:
                    held[-1][2] += r[2]
                    held[-1][4] = held[-1][4] if r[4] is None else r[4]
                    continue
                if held and held[-1][0] != r[0]:
                    groups += 1
                    if len(held) >= 8000 or groups >= 60_000:
                        yield done()
                        held, groups = [], 0
                held.append(list(r))
        if held:
            yield done()

    slices = rows.mapInArrow(cut, "h long, s binary, n int, before int, slice binary")
    found = stored(slices.repartition("h").sortWithinPartitions("h", "s").mapInArrow(index, "s binary, slot long, level int, a long, b long"))
    hits = spark.sparkContext.broadcast(filter_bits(found.select(F.col("slot").alias("h")), FILTER_BITS))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places of slices of which something was found; neighbours of one text that have the same slice, as in text of a short period, are one row."""
        for at, _, _, slices in around(batches):
            out: list[list] = []
            digests = _digests(slices)
            some = in_filter(hits.value, np.array([_slot(d) for d in digests], np.int64)).tolist()
            for (t1, t2, p), d, likely in zip(at, digests, some):
                if not likely:
                    continue
                if out and out[-1][0] == d and out[-1][1] == t1 and out[-1][2] == t2:
                    out[-1][4] = p
                else:
                    out.append([d, t1, t2, p, p])
            yield _batch(out, _PLACES)

    everywhere = rows.mapInArrow(places, "s binary, t1 long, t2 long, p long, q long")
    marks = everywhere.join(found, "s").select("t1", "t2", "level", (F.col("p") + F.col("a")).alias("a"), (F.col("q") + F.col("b")).alias("b"))
    for k, n in enumerate(lengths):
        marks = marks.unionByName(copies.filter(F.col("b") >= n).select("t1", "t2", F.lit(k).alias("level"), F.lit(0).cast("long").alias("a"), "b"))
    if not any_hot:
        return marks

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hashes of the strings whose least value is that of a hot anchor."""
        for texts, x in blocks(batches):
            at = np.flatnonzero(sketch.has(hot.value, x.hash))
            if not len(at):
                continue
            marked = np.zeros(len(x.least) + 1, bool)
            for p in x.at[at].tolist():
                a = max(0, p - lead)
                marked[a : p + 1][: len(x.least) - a] |= x.least[a : p + 1] == x.h[p]
            for o, (i, data, lo, _, _) in enumerate(x.pieces):
                a, b = x.edge[o], x.edge[o + 1]
                starts = np.flatnonzero(marked[a:b])
                for k, n in enumerate(lengths):
                    # A string that goes on behind this piece is taken from the whole text.
                    s = starts[starts + lo + n <= len(texts[i][2])]
                    if len(s):
                        first = int(s[0]) + lo
                        w = _window_hashes(texts[i][2][first : int(s[-1]) + lo + n], s + lo - first, n)
                        yield pa.RecordBatch.from_arrays([pa.array(w[:, 0]), pa.array(w[:, 1]), *(pa.array(np.full(len(s), v), f.type) for v, f in zip((k, *texts[i][:2]), list(_WINDOWS)[2:5])), pa.array(s + lo)], schema=_WINDOWS)

    w = rows.mapInArrow(windows, "w1 long, w2 long, level int, t1 long, t2 long, a long")
    # Pieces of a long text may both give a string; places are distinct.
    w = stored(w.distinct())
    again = w.groupBy("w1", "w2", "level").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    length = F.element_at(F.array(*map(F.lit, lengths)), F.col("level") + 1)
    return marks.unionByName(w.join(again, ["w1", "w2", "level"]).select("t1", "t2", "level", "a", (F.col("a") + length).alias("b")))


def keys(text: str) -> list[Column]:
    x = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(x).alias("t1"), F.xxhash64(x, F.lit(1)).alias("t2")]


def remove(docs: DataFrame, length: int = LENGTH, text: str = "text", keep: tuple[str, ...] = ("doc_id",), also: tuple[int, ...] = ()) -> DataFrame:
    """The columns in ``keep``, n_bytes, n_removed, n_spans and kept (the bytes that are left) of every row, and covered_N for each length N in ``also``.

    Texts are taken as UTF-8 bytes, null as empty. Bytes that a repeated string of ``length``
    bytes covers are removed; covered_N counts those that strings of N bytes would cover. What is
    left may begin or end inside a character. Rows that repeat a text of at least ``length`` bytes
    lose the whole of it; shorter texts never lose anything. Null and repeated ids play no part.
    """
    lengths = tuple(sorted({length, *also}))
    if lengths[0] <= K:
        raise ValueError(f"strings must be longer than {K} bytes")
    marks = _spans(docs, lengths, text)
    spans = marks.groupBy("t1", "t2").agg(F.collect_set(F.struct("level", "a", "b")).alias("spans"))
    rows = docs.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(keep)], *keys(text), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("bytes"))
    rows = rows.join(spans, ["t1", "t2"], "left").select(*[f"__{i}" for i in range(len(keep))], "bytes", "spans")
    own = lengths.index(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            n, gone, count, kept = [], [], [], []
            covered: list[list[int]] = [[] for _ in also]
            for x, found in zip(b.column("bytes").to_pylist(), b.column("spans").to_pylist()):
                by_level = {k: _merged([(r["a"], r["b"]) for r in found or [] if r["level"] == k]) for k in range(len(lengths))}
                at, parts = 0, []
                for start, end in by_level[own]:
                    parts.append(x[at:start])
                    at = end
                parts.append(x[at:])
                kept.append(b"".join(parts))
                n.append(len(x))
                gone.append(len(x) - len(kept[-1]))
                count.append(len(by_level[own]))
                for out, v in zip(covered, also):
                    out.append(sum(e - a for a, e in by_level[lengths.index(v)]))
            longs = [pa.array(v, pa.int64()) for v in (n, gone, count, *covered)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *longs, pa.array(kept, pa.binary())], names=names)

    names = [*keep, "n_bytes", "n_removed", "n_spans", *(f"covered_{v}" for v in also), "kept"]
    kinds = [*(docs.schema[c].dataType.simpleString() for c in keep), *["long"] * (3 + len(also)), "binary"]
    return rows.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in zip(names, kinds)))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_passage: bytes that repeated strings of PASSAGE bytes cover."""
    out = remove(spark.read.parquet(f"{sf_dir}/documents.parquet"), also=(PASSAGE,))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.col(f"covered_{PASSAGE}").alias("n_passage"))
