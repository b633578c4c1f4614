"""Language-model scoring by a probabilistic suffix tree over words.

The root holds the add-one word distribution of the training texts. A context of up to ``DEPTH``
words becomes a state if a gram that it begins was seen ``SUPPORT`` times or more and its
next-word distribution diverges enough from that of its longest shorter state. Grams seen
``SUPPORT`` times or more are kept. With C(s) the count of a context, K(s) the sum of its kept
grams and s' its longest shorter state,

    P(w | s) = (c(sw) + (C(s) - K(s) + 1) P(w | s')) / (C(s) + 1)

with c(sw) of kept grams only, so every distribution sums to one. s is retained if
sum c(sw) ln(c(sw) / C(s) / P(w | s')) over its kept grams exceeds ``PENALTY`` for each of
them and one more. That sum is at most sum c(sw) ln(1 / P(w | s')), for all longer contexts
too, so a context is only lengthened while this bound leaves room for a state.

Texts are coded once into blocks of a bounded size. Level by level the blocks send grams to be
counted: those that neither a sketch nor a filter of fixed size can rule out. Pairs of the
``RESIDENT`` most frequent words are numbers; they travel sorted and packed, merged by task, in one
row for each part of their first words, so a part settles its contexts by itself. Other grams are
counted by DataFrame aggregation. A block sends its words once, packed, and their counts come back in
the same order. At last blocks ask for what concerns them, but for the ``RESIDENT`` most frequent
entries of the model, which all of them get; nothing that grows with the corpus is broadcast or
gathered. Asked keys travel packed as well, and the answers, which are whole numbers, come back in
their order without them. Words, contexts and grams are known by 64-bit hashes; a word that a single
block holds is counted there.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgraph.llm import sketch
from loamgraph.llm._common import crc32_mod, filter_bits, forget, in_filter, modest_batches, release, stored
from loamgraph.llm.shingles import _words, mix

SUPPORT, PENALTY = 4, 2.0
#: The most words of a context, as in the tree's definition by its greatest length of a suffix.
DEPTH = 3
#: Characters of a block; a longer text is a block of its own.
BLOCK_CHARS = 6_000_000
#: Bits of the filters of grams and contexts.
FILTER_BITS = 1 << 27
#: At most so many entries of the model, the most frequent ones, go to all tasks, and so many words.
RESIDENT = 1 << 20
#: Words, grams and the model come in 2 ** PART_BITS parts at least, and in one more for each 2 ** PART_TOKENS tokens.
PART_BITS, PART_TOKENS = 6, 24
#: Different grams that a task merges before it sends them.
HELD = 4_000_000
#: Whether a step's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The token that ends a text.
END = np.uint64(0x1F2E3D4C5B6A7988)
_U = np.uint64


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a.astype(np.uint64) * _U(0xD6E8FEB86659FD93) + b.astype(np.uint64))


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> _U(37)).astype(np.int64)


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts in turn, each with its end, and tokens by text."""
    words, sizes = [], []
    coded = [x.encode("utf-8", "surrogatepass") for x in texts]
    at = 0
    while at < len(coded):
        to, size = at, 0
        while to < len(coded) and (to == at or size + len(coded[to]) < 1 << 19):
            size += len(coded[to]) + 1
            to += 1
        part = coded[at:to]
        data = np.frombuffer(b" ".join([b"", *part, b""]), np.uint8)
        starts, _, h = _words(data) if any(x.strip(b" \t\n\v\f\r") for x in part) else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
        stops = np.searchsorted(starts, np.cumsum([1, *(len(x) + 1 for x in part)])[1:])
        words.append(np.insert(h, stops, END))
        sizes.append(np.diff(stops, prepend=0) + 1)
        at = to
    return np.concatenate(words), np.concatenate(sizes)


def _packed(x: np.ndarray) -> bytes:
    """Numbers by planes of bytes, compressed: high bytes that are alike cost little."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T), codec="zstd", asbytes=True)


def _unpacked(data: bytes, dtype: str, n: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(data, decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(dtype).ravel()


class Block:
    """The tokens of a block with what precedes each in its text."""

    def __init__(self, row: dict):
        self.block = row["block"]
        self.n = np.array(row["n"], np.int64)
        self.vocabulary = np.frombuffer(row["vocabulary"], "<u8")
        self.ids = _unpacked(row["ids"], "<u4", int(self.n.sum()))
        self.w = self.vocabulary[self.ids]
        self.doc_id, self.held = row["doc_id"], np.array(row["held"], bool)
        ends = np.cumsum(self.n)
        self.place = np.arange(len(self.w)) - np.repeat(ends - self.n, self.n)
        self.train = ~np.repeat(self.held, self.n)

    def counts(self) -> np.ndarray:
        """How often each word of the vocabulary is in training."""
        return np.bincount(self.ids, self.train, len(self.vocabulary)).astype(np.int64)

    def contexts(self, depth: int) -> Iterator[tuple[int, np.ndarray]]:
        """(d, hashes of the d words before each token) from one word on."""
        context = np.roll(self.w, 1)
        yield 1, context
        for d in range(2, depth + 1):
            context = _join(np.roll(self.w, d), context)
            yield d, context


def _factors(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the different keys, in no order, each is, and these keys."""
    found = pa.array(key).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary.to_numpy()


def _distinct(key: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Each key once, in no order, these columns there, and how often it comes."""
    which, key = _factors(key)
    first = np.empty(len(key), np.int64)
    first[which[::-1]] = np.arange(len(which))[::-1]
    return [key, *(c[first] for c in columns), np.bincount(which, minlength=len(key)).astype(np.int64)]


def _merged(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, sorted, and the sum of n there."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[at], np.add.reduceat(n, at) if len(at) else n


def _code(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = 0

        def block() -> pa.RecordBatch:
            w, n = tokens([r[1] for r in held])
            ids, vocabulary = _factors(w)
            often = np.bincount(ids, minlength=len(vocabulary))
            order = np.argsort(-often, kind="stable")  # frequent words get small numbers, which pack well
            rank = np.empty(len(order), "<u4")
            rank[order] = np.arange(len(order), dtype="<u4")
            columns = [[number], [[r[0] for r in held]], [[r[2] for r in held]], [n.tolist()], [vocabulary[order].astype("<u8").tobytes()], [_packed(rank[ids])]]
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["block", "doc_id", "held", "n", "vocabulary", "ids"])

        release()
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if held and size + len(r[1]) > BLOCK_CHARS:
                    yield block()
                    held, size, number = [], 0, number + 1
                held.append(r)
                size += len(r[1])
        if held:
            yield block()

    return docs.mapInArrow(run, "block long, doc_id array<long>, held array<boolean>, n array<long>, vocabulary binary, ids binary")


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _each(blocks: DataFrame, make, schema: str) -> DataFrame:
    """make(Block) gives a list of columns."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                columns = make(Block(row))
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    return blocks.mapInArrow(run, schema)


def _context(x: Block, depth: int) -> np.ndarray:
    for _, context in x.contexts(depth):
        pass
    return context


def _filter(spark: SparkSession, *keys: DataFrame):
    """A filter over columns of 64-bit hashes, at the places that _slot gives."""
    every = None
    for df in keys:
        one = df.select(F.shiftrightunsigned(F.col(df.columns[0]), 37).alias("h"))
        every = one if every is None else every.unionByName(one)
    return spark.sparkContext.broadcast(filter_bits(every, FILTER_BITS))


def _entry(code: int, key: np.ndarray) -> np.ndarray:
    """The key of an entry of the model: code 2 d grams and 2 d + 1 states of d words."""
    return mix(key + _U(code * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


class Model:
    """Two numbers, v and u, by key, among those that all tasks have and those a block got."""

    def __init__(self, *tables: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.tables = [t for t in tables if len(t[0])]

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """v and u; v is -1 where there is no such key."""
        v, u = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
        for keys, values, others in self.tables:
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = np.flatnonzero((keys[at] == key) & (v < 0))
            v[hit], u[hit] = values[at[hit]], others[at[hit]]
        return v, u


def _words_sent(x: Block, n: np.ndarray, several, support: int) -> np.ndarray:
    """Which words of the vocabulary are counted with other blocks, by their hashes: those that others may hold and those that may be in kept grams."""
    at = np.flatnonzero(sketch.has(several.value, x.vocabulary) | (n >= support))
    return at[np.argsort(x.vocabulary[at])]


def _wanted(x: Block, depth: int, of_states, of_grams) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What a block wants to know: places, different keys, and which of them each place has. By depth, of the contexts that may be states and of the grams that these may have."""
    previous = np.roll(x.ids, 1)
    for d, context in x.contexts(depth):
        at = np.flatnonzero(x.place >= d)
        if d == 1:
            at = at[in_filter(of_states.value, _slot(x.vocabulary))[previous[at]]]
            which, words = _factors(previous[at])
            keys = x.vocabulary[words]
        else:
            at = at[in_filter(of_states.value, _slot(context[at]))]
            which, keys = _factors(context[at])
        yield at, _entry(2 * d + 1, keys), which
        key = _join(context[at], x.w[at])
        some = in_filter(of_grams.value, _slot(key))
        which, keys = _factors(key[some])
        yield at[some], _entry(2 * d, keys), which


def _asked(wanted: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], common: Model) -> np.ndarray:
    """The keys that not all tasks have, sorted."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(k[common.find(k)[0] < 0] for _, k, _ in wanted)]))


def _edges(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each of the 2 ** bits parts of sorted keys begins, and the end."""
    return np.append(np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << _U(64 - bits)), len(keys))


def _steps(keys: np.ndarray) -> bytes:
    return _packed(np.diff(keys, prepend=_U(0)))


def _from_steps(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpacked(data, "<u8", n), dtype=np.uint64)


def _words_counted(sent: pa.Table) -> pa.Table:
    """Of the words (block, part, n, keys, c, total, known) of a part: a row without a block that holds each word once, and for each row of a block the counts in its order."""
    sizes = sent.column("n").to_pylist()
    key = np.concatenate([_from_steps(k, n) for k, n in zip(sent.column("keys").to_pylist(), sizes)])
    which, key = _factors(key)
    c = np.bincount(which, np.concatenate([_unpacked(x, "<i8", n) for x, n in zip(sent.column("c").to_pylist(), sizes)]), len(key)).astype(np.int64)
    replies = [_packed(x) for x in np.split(c[which], np.cumsum(sizes)[:-1])]
    order = np.argsort(key)
    columns = {
        "block": [*sent.column("block").to_pylist(), None],
        "part": [*sent.column("part").to_pylist(), sent.column("part")[0].as_py()],
        "n": [*sizes, len(key)],
        "keys": [*[b""] * len(sizes), _steps(key[order])],
        "c": [*replies, _packed(c[order])],
        "total": [*sent.column("total").to_pylist(), int(c.sum())],
        "known": [*sent.column("known").to_pylist(), int((c > 0).sum())],
    }
    return pa.table(columns, WORDS)


WORDS = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("c", pa.binary()), ("total", pa.int64()), ("known", pa.int64())])
WORDS_SQL = "block long, part int, n long, keys binary, c binary, total long, known long"


def _pair_bounds(words: int, bits: int) -> np.ndarray:
    """Where the parts of pairs begin, and the end, in numbers of first words."""
    return np.arange((1 << bits) + 1, dtype=np.int64) * words // (1 << bits)


def _pairs_sent(x: Block, top: np.ndarray, often) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs of words of top in training that may be kept, as numbers, and how often each comes."""
    at = np.minimum(np.searchsorted(top, x.vocabulary), max(len(top) - 1, 0))
    number = np.where(top[at] == x.vocabulary, at, -1) if len(top) else np.full(len(x.vocabulary), -1)
    w = number[x.ids]
    a = np.roll(w, 1)
    some = x.train & (x.place > 0) & (a >= 0) & (w >= 0)
    pair, n = _distinct((a[some].astype(np.uint64) << _U(32)) | w[some].astype(np.uint64))
    has = sketch.has(often, _join(top[(pair >> _U(32)).astype(np.int64)], top[(pair & _U(0xFFFFFFFF)).astype(np.int64)]))
    return pair[has], n[has]


def _other_pairs(x: Block, top: np.ndarray, often, support: int) -> list:
    """(a, w, n) of pairs that may be kept, but have a word that is not in top."""
    at = np.minimum(np.searchsorted(top, x.vocabulary), max(len(top) - 1, 0))
    other = (top[at] != x.vocabulary if len(top) else np.ones(len(x.vocabulary), bool))[x.ids]
    at = np.flatnonzero(x.train & (x.place > 0) & (other | np.roll(other, 1)))
    a, w = np.roll(x.w, 1)[at], x.w[at]
    key, a, w, n = _distinct(_join(a, w), a, w)
    has = sketch.has(often, key)
    return [_signed(a[has]), _signed(w[has]), pa.array(n[has])]


LEVEL_SQL = "a long, key long, c long, seen long, rest long, p double, open boolean"


def _first_level(common, root: int, penalty: float, support: int):
    """Kept pairs of a part, with what its contexts are: of packed pairs of resident words, and of others (a, w, c, c0, seen)."""

    def run(packed: pa.Table, others: pa.Table | None = None) -> pa.Table:
        top, often, _ = common.value
        sizes = packed.column("n").to_pylist()
        pair, c = _merged(
            np.concatenate([np.zeros(0, np.uint64), *(_from_steps(k, n) for k, n in zip(packed.column("keys").to_pylist(), sizes))]),
            np.concatenate([np.zeros(0, np.int64), *(_unpacked(k, "<i8", n) for k, n in zip(packed.column("c").to_pylist(), sizes))]),
        )
        pair, c = pair[c >= support], c[c >= support]
        first, second = (pair >> _U(32)).astype(np.int64), (pair & _U(0xFFFFFFFF)).astype(np.int64)
        a, w, c0, seen = top[first], top[second], often[second], often[first]
        if others is not None and len(others):
            more = {k: others.column(k).to_numpy() for k in ("a", "w", "c", "c0", "seen")}
            a, w = (np.append(x, more[k].view(np.uint64)) for x, k in ((a, "a"), (w, "w")))
            c, c0, seen = (np.append(x, more[k]) for x, k in ((c, "c"), (c0, "c0"), (seen, "seen")))
            order = np.argsort(a, kind="stable")
            a, w, c, c0, seen = (x[order] for x in (a, w, c, c0, seen))
        lower = (c0 + 1) / root
        at = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
        of = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(a))))
        total = lambda x: np.add.reduceat(x, at)[of] if len(at) else x
        rest = seen - total(c) + 1
        state = total(c * np.log(c / seen / lower)) > penalty * (total(np.ones(len(a), np.int64)) + 1)
        p = np.where(state, (c + rest * lower) / (seen + 1), lower)
        opened = total(c * np.maximum(-np.log(p), 0)) > 2 * penalty
        return pa.table([_signed(a), _signed(_join(a, w)), pa.array(c), pa.array(seen), pa.array(rest, mask=~state), pa.array(p), pa.array(opened)], names=["a", "key", "c", "seen", "rest", "p", "open"])

    return run


def _sent(blocks: DataFrame, make, pack, schema: str) -> DataFrame:
    """pack(keys, counts) of what make(Block) gives for the blocks of a task: different keys and how often each comes."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def rows() -> pa.RecordBatch:
            key, n = _merged(*(np.concatenate(x) for x in zip(*held)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in pack(key, n)], names=names)

        for b in batches:
            for row in b.to_pylist():
                held.append(make(Block(row)))
                if sum(len(x[0]) for x in held) >= HELD:
                    yield rows()
        if held:
            yield rows()

    return blocks.mapInArrow(run, schema)


def _answers(asked: pa.Table, model: pa.Table) -> pa.Table:
    """(block, part, n, v, u): for the keys (block, part, n, keys) asked of a part of the model (k, v, u), v + 1 (0: no such key) and u in their order."""
    k = model.column("k").to_numpy().view(np.uint64)
    order = np.argsort(k)
    found = Model((k[order], model.column("v").to_numpy()[order], model.column("u").to_numpy()[order]))
    v, u = [], []
    for n, keys in zip(asked.column("n").to_pylist(), asked.column("keys").to_pylist()):
        x, y = found.find(_from_steps(keys, n))
        v.append(_packed(x + 1))
        u.append(_packed(y))
    return pa.table([asked.column("block"), asked.column("part"), asked.column("n"), pa.array(v, pa.binary()), pa.array(u, pa.binary())], names=["block", "part", "n", "v", "u"])


def _scorer(total: int, distinct: int, depth: int, support: int, common, several, of_states, of_grams):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        resident = Model(common.value)
        got = sorted(zip(*(right.column(c).to_pylist() for c in ("words", "part", "n", "v", "u"))))
        of_words = np.concatenate([np.zeros(0, np.int64), *(_unpacked(r[3], "<i8", r[2]) for r in got if r[0])])
        v, u = (np.concatenate([np.zeros(0, np.int64), *(_unpacked(r[i], "<i8", r[2]) for r in got if not r[0])]) for i in (3, 4))
        for row in left.to_pylist():
            x = Block(row)
            wanted = [*_wanted(x, depth, of_states, of_grams)]
            model = Model(common.value, (_asked(wanted, resident), v - 1, u))
            count = x.counts()  # right for the other words, which are in no other block
            count[_words_sent(x, count, several, support)] = of_words
            count = count[x.ids]
            p0 = (count + 1) / (total + distinct + 1)
            p = p0.copy()
            for (at, keys, which), (at_own, keys_own, which_own) in zip(wanted[::2], wanted[1::2]):
                own = np.zeros(len(p), np.int64)
                own[at_own] = np.maximum(model.find(keys_own)[0], 0)[which_own]
                seen, rest = (z[which] for z in model.find(keys))
                at, seen, rest = at[seen >= 0], seen[seen >= 0], rest[seen >= 0]
                p[at] = (own[at] + rest * p[at]) / (seen + 1)
            starts = np.cumsum(x.n) - x.n
            total_of = lambda v: np.add.reduceat(v, starts)  # noqa: E731 - every text has its end
            out.append(
                pa.table(
                    [pa.array(x.doc_id, pa.int64()), pa.array(x.held), pa.array(x.n), pa.array(total_of((count > 0).astype(np.int64))), pa.array(np.full(len(x.n), total, np.int64)), pa.array(total_of(np.log10(p0))), pa.array(total_of(np.log10(p)))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )
            )
        return pa.concat_tables(out) if out else None

    return run


def _mapped(df: DataFrame, make, schema: str) -> DataFrame:
    """make(batch) gives a list of arrays."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(make(b), names=names)

    return df.mapInArrow(run, schema)


def _unsigned(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


class Entries(tuple):
    """Sorted keys and two numbers of each, which travel packed."""

    def __reduce__(self):
        return _entries, (len(self[0]), _steps(self[0]), _packed(self[1]), _packed(self[2]))


def _entries(n: int, keys: bytes, v: bytes, u: bytes) -> Entries:
    return Entries((_from_steps(keys, n), _unpacked(v, "<i8", n), _unpacked(u, "<i8", n)))


def _most_frequent(model: DataFrame) -> Entries:
    """Keys and numbers of at most RESIDENT entries."""
    # As many rows as there are different counts: few, since n of them need n * n / 2 tokens.
    least, room = 1, RESIDENT
    for r in sorted(model.groupBy("c").agg(F.count("*").alias("k")).collect(), reverse=True):
        room -= r.k
        if room < 0:
            least = r.c + 1
            break
    got = model.filter(F.col("c") >= least).select("k", "v", "u").toArrow()
    k, v, u = got["k"].to_numpy().view(np.uint64), got["v"].to_numpy(), got["u"].to_numpy()
    order = np.argsort(k)
    return Entries((k[order], v[order], u[order]))


def _level(kept: DataFrame, counts: DataFrame, penalty: float) -> DataFrame:
    """Kept grams (a, key, c, lower), lower being P(w | s'), with the counts (a, seen) of their contexts: adds seen and rest (of states, else null), p and open, whether the context may be lengthened."""
    of = Window.partitionBy("a")
    each = kept.join(counts, "a").withColumn("G", F.sum(F.col("c") * F.log(F.col("c") / F.col("seen") / F.col("lower"))).over(of))
    each = each.withColumn("T", F.count("*").over(of)).withColumn("K", F.sum("c").over(of))
    rest = F.when(F.col("G") > penalty * (F.col("T") + 1), F.col("seen") - F.col("K") + 1)
    p = F.coalesce((F.col("c") + F.col("rest") * F.col("lower")) / (F.col("seen") + 1), "lower")
    out = each.withColumn("rest", rest).withColumn("p", p)
    bound = F.sum(F.col("c") * F.greatest(-F.log("p"), F.lit(0.0))).over(of) > 2 * penalty
    return stored(out.select("a", "key", "c", "seen", "rest", "p", bound.alias("open")))


def _score(docs: DataFrame, held_out, text: str, doc_id: str, support: int, penalty: float, depth: int) -> DataFrame:
    spark = docs.sparkSession
    modest_batches(spark, 500)
    marked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    blocks = stored(_code(marked))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        for b in batches:
            for row in b.to_pylist():
                x = Block(row)
                yield 0, x.vocabulary
                at = x.train & (x.place > 0)
                key, n = _distinct(_join(np.roll(x.w, 1)[at], x.w[at]))
                yield 1, np.repeat(key, np.minimum(n, support))

    sent = blocks.mapInArrow(lambda batches: sketch.send(seen(batches)), sketch.SCHEMA)
    several, often = (spark.sparkContext.broadcast(x) for x in sketch.frequent(sent, (0, 2), (1, support)))

    n_tokens = blocks.agg(F.coalesce(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda x, y: x + y)), F.lit(0))).first()[0]
    bits = max(PART_BITS, (int(n_tokens) >> PART_TOKENS).bit_length())

    def words_of(x: Block) -> list:
        n = x.counts()
        at = _words_sent(x, n, several, support)
        rest = np.delete(n, at)
        k, n = x.vocabulary[at], n[at]
        edge = _edges(k, bits)
        some = np.flatnonzero(np.diff(edge)) if len(k) else np.zeros(1, np.int64)
        of = lambda y: [int(y), *[0] * (len(some) - 1)]
        return [pa.array(y, f.type) for y, f in zip([[x.block] * len(some), some, np.diff(edge)[some], [_steps(k[edge[i] : edge[i + 1]]) for i in some], [_packed(n[edge[i] : edge[i + 1]]) for i in some], of(rest.sum()), of((rest > 0).sum())], WORDS)]

    words = stored(_each(blocks, words_of, WORDS_SQL).groupBy("part").applyInArrow(_words_counted, WORDS_SQL))
    total, distinct = words.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()

    def unpacked(b: pa.RecordBatch) -> list:
        rows = [(_from_steps(k, n), _unpacked(c, "<i8", n)) for n, k, c in zip(*(b.column(i).to_pylist() for i in range(3)))]
        k, c = (np.concatenate([r[i] for r in rows] or [np.zeros(0, np.int64)]) for i in (0, 1))
        return [_signed(k[c >= support]), pa.array(c[c >= support])]

    unigrams = stored(_mapped(words.filter("block IS NULL").select("n", "keys", "c"), unpacked, "w long, c long"))
    top = spark.sparkContext.broadcast(_most_frequent(unigrams.select(F.col("w").alias("k"), F.col("c").alias("v"), F.lit(0).cast("long").alias("u"), "c")))
    residents = len(top.value[0])

    def pairs_packed(key: np.ndarray, n: np.ndarray) -> list:
        edge = np.searchsorted(key, _pair_bounds(residents, bits).astype(np.uint64) << _U(32))
        some = np.flatnonzero(np.diff(edge))
        return [some.astype(np.int32), np.diff(edge)[some], pa.array([_steps(key[edge[i] : edge[i + 1]]) for i in some], pa.binary()), pa.array([_packed(n[edge[i] : edge[i + 1]]) for i in some], pa.binary())]

    levels: list[DataFrame] = []
    pairs = _sent(blocks, lambda x: _pairs_sent(x, top.value[0], often.value), pairs_packed, "part int, n long, keys binary, c binary").groupBy("part")
    first = _first_level(top, total + distinct + 1, penalty, support)
    if unigrams.count() == residents:
        levels.append(stored(pairs.applyInArrow(lambda packed: first(packed), LEVEL_SQL)))
    else:
        others = _each(blocks, lambda x: _other_pairs(x, top.value[0], often.value, support), "a long, w long, n long").groupBy("a", "w").agg(F.sum("n").alias("c")).filter(F.col("c") >= support)
        others = others.join(unigrams.select("w", F.col("c").alias("c0")), "w").join(unigrams.select(F.col("w").alias("a"), F.col("c").alias("seen")), "a").select("a", "w", "c", "c0", "seen")

        def dealt(b: pa.RecordBatch) -> list:
            at = np.minimum(np.searchsorted(top.value[0], _unsigned(b, "a")), residents - 1)
            return [pa.array((np.searchsorted(_pair_bounds(residents, bits), at, "right") - 1).astype(np.int32)), *b.columns]

        others = _mapped(others, dealt, "part int, a long, w long, c long, c0 long, seen long")
        levels.append(stored(pairs.cogroup(others.groupBy("part")).applyInArrow(lambda packed, others: first(packed, others), LEVEL_SQL)))
    forget(unigrams)
    for d in range(1, depth + 1):
        if d > 1:
            levels.append(_level(kept, counts, penalty))
            forget(kept)
        longer = levels[-1].filter("open")
        if d == depth or longer.isEmpty():
            break
        may = _filter(spark, longer.select("key"))

        def grams(x: Block, d=d, may=may) -> tuple[np.ndarray, ...]:
            """(key, a, w, s, n) of those whose shorter gram may be lengthened."""
            context = longer_context = None
            for k, c in x.contexts(d + 1):
                context, longer_context = (c, None) if k == d else (context, c)
            at = np.flatnonzero(x.train & (x.place > d))
            at = at[in_filter(may.value, _slot(_join(context[at], x.w[at])))]
            return _distinct(_join(longer_context[at], x.w[at]), longer_context[at], x.w[at], context[at])

        def lengthened(batches: Iterator[pa.RecordBatch], grams=grams) -> Iterator[tuple[int, np.ndarray]]:
            for b in batches:
                for row in b.to_pylist():
                    key, *_, n = grams(Block(row))
                    yield 0, np.repeat(key, np.minimum(n, support))

        sent = blocks.mapInArrow(lambda batches, of=lengthened: sketch.send(of(batches)), sketch.SCHEMA)
        likely = spark.sparkContext.broadcast(sketch.frequent(sent, (0, support))[0])

        def grams_of(x: Block, grams=grams, likely=likely) -> list:
            key, a, w, s, n = grams(x)
            has = sketch.has(likely.value, key)
            return [_signed(a[has]), _signed(w[has]), _signed(s[has]), pa.array(n[has])]

        kept = _each(blocks, grams_of, "a long, w long, s long, n long").groupBy("a", "w").agg(F.first("s").alias("s"), F.sum("n").alias("c")).filter(F.col("c") >= support)
        kept = _mapped(kept, lambda b: [b.column("a"), *(_signed(_join(_unsigned(b, x), _unsigned(b, "w"))) for x in "as"), b.column("c")], "a long, key long, k long, c long")
        kept = stored(kept.join(levels[-1].select(F.col("key").alias("k"), F.col("p").alias("lower")), "k").select("a", "key", "c", "lower"))
        if d == 1:  # a context of two words is a pair, and each kept gram's is kept
            counts = levels[0].select(F.col("key").alias("a"), F.col("c").alias("seen"))
            continue
        wanted = _filter(spark, kept.select("a"))

        def contexts_of(x: Block, d=d, wanted=wanted) -> list:
            context = _context(x, d + 1)
            at = np.flatnonzero(x.train & (x.place > d))
            context = context[at][in_filter(wanted.value, _slot(context[at]))]
            a, n = _distinct(context)
            return [_signed(a), pa.array(n)]

        counts = _each(blocks, contexts_of, "a long, n long").groupBy("a").agg(F.sum("n").alias("seen"))

    # The model: the count of each gram of a state, and what a state saw, with what its kept grams leave.
    nothing = F.lit(0).cast("long")
    parts = []
    for d, df in enumerate(levels, 1):
        state = df.filter("rest IS NOT NULL")
        parts.append(state.select(F.lit(2 * d).alias("code"), F.col("key").alias("a"), F.col("c").alias("v"), nothing.alias("u"), "c"))
        parts.append(state.groupBy("a").agg(F.first("seen").alias("v"), F.first("rest").alias("u")).select(F.lit(2 * d + 1).alias("code"), "a", "v", "u", F.col("v").alias("c")))
    model = functools.reduce(DataFrame.unionByName, parts)

    def entries(b: pa.RecordBatch) -> list:
        code, x = b.column("code").to_numpy(), _unsigned(b, "a")
        k = np.zeros(len(code), np.uint64)
        for c in np.unique(code).tolist():
            at = code == c
            k[at] = _entry(c, x[at])
        return [pa.array((k >> _U(64 - bits)).astype(np.int32)), _signed(k), b.column("v"), b.column("u"), b.column("c")]

    model = stored(_mapped(model, entries, "part int, k long, v long, u long, c long"))
    most = len(levels)
    states = [df.filter("rest IS NOT NULL") for df in levels]
    of_states = _filter(spark, *(df.select("a") for df in states))
    of_grams = _filter(spark, *(df.select("key") for df in states))
    common = spark.sparkContext.broadcast(_most_frequent(model))

    forget(*levels)

    def asked_of(x: Block) -> list:
        k = _asked(_wanted(x, most, of_states, of_grams), Model(common.value))
        edge = _edges(k, bits)
        some = np.flatnonzero(np.diff(edge))
        return [pa.array(np.full(len(some), x.block)), pa.array(some.astype(np.int32)), pa.array(np.diff(edge)[some]), pa.array([_steps(k[edge[i] : edge[i + 1]]) for i in some], pa.binary())]

    asked = _each(blocks, asked_of, "block long, part int, n long, keys binary")
    got = asked.groupBy("part").cogroup(model.select("part", "k", "v", "u").groupBy("part")).applyInArrow(_answers, "block long, part int, n long, v binary, u binary")
    got = got.select("block", F.lit(False).alias("words"), "part", "n", "v", "u")
    got = got.unionByName(words.filter("block IS NOT NULL").select("block", F.lit(True).alias("words"), "part", "n", F.col("c").alias("v"), F.lit(b"").alias("u")))
    return blocks.groupBy("block").cogroup(got.groupBy("block")).applyInArrow(_scorer(total, distinct, most, support, common, several, of_states, of_grams), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame, held_out, text: str = "text", doc_id: str = "doc_id", support: int = SUPPORT, penalty: float = PENALTY, depth: int = DEPTH) -> DataFrame:
    """Score every whole text by a tree learned from those that are not held out (a boolean column; null counts as false).

    doc_id, held_out, n_tokens and n_known (with the end), train_tokens, base_score (the
    root alone) and score, in log10. A null or empty text is its end only. Repeated rows are
    scored, and learned from, each; with nothing to learn from all tokens are unknown.
    """
    spark = docs.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # every step here is written or gathered, so nobody reads its shuffle files again
    try:
        return _score(docs, held_out, text, doc_id, support, penalty, depth)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), crc32_mod("doc_id", 7) == 2)
