"""Questions against all texts, in blocks: trigram, term and literal matches as matrix products, with only the best of each question kept.

A question set is taken in blocks of ``QUESTIONS``, ``BLOCKS`` of them in a pass, for which each text is
cut into trigrams and terms once. A task turns a few hundred texts into rows of
zeros and ones over the trigrams and terms that the questions have, multiplies them with the
questions' own, and keeps the best of each question so far; at its end it gives at most k
rows for each question and list. No pair of a question and a text leaves its task otherwise,
so neither common trigrams nor long texts make rows.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import cache, reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamgraph.functions import text as T
from loamgraph.session import reachable

QUESTIONS, TEXTS, VECTORS = 512, 256, 65_536
#: Blocks of questions that one pass over the texts takes.
BLOCKS = 4
#: Characters whose trigrams are made at once.
CHARS = 1 << 20
#: Similarity that a match by trigrams has at least.
MINIMUM = 0.1
#: Characters of a text's head, in which terms count.
HEAD = 5000
TERM = re.compile(r"[a-z0-9]+(?:[-/][a-z0-9]+)*")

# Terms of a question, parts of a document's type, and what such a pair adds.
BOOSTS = [
    (["insurance", "policy", "coverage", "premium"], ["insurance", "policy"], 0.12),
    (["tax", "irs", "return", "w-2", "1099"], ["tax", "financial"], 0.12),
    (["medical", "doctor", "diagnosis", "medication", "lab", "labs", "blood", "bloodwork"], ["medical"], 0.12),
    (["mortgage", "loan", "escrow", "home"], ["mortgage", "statement", "contract"], 0.10),
    (["vehicle", "auto", "car", "truck", "vin"], ["vehicle", "registration", "insurance"], 0.10),
]
#: What hybrid ranking gives for similarity, for each term found, and for a superseded text.
SIMILARITY, HIT, OLD = 0.3, 0.18, 0.18

FOUND = "qid long, list string, document_id long, chunk_index int, exact boolean, similarity double, cosine double, hits long, key long"


def flags(text: Column, side: int) -> Column:
    """A bit for each rule of BOOSTS of which this side (0: questions, 1: types) holds a term."""
    return reduce(lambda a, b: a + b, [F.when(T.contains_any(text, rule[side]), 1 << i).otherwise(0) for i, rule in enumerate(BOOSTS)])


@cache
def _letters() -> np.ndarray:
    """Which code points are letters or digits, as words are made of."""
    return np.array([chr(i).isalnum() for i in range(sys.maxunicode + 1)])


def _codes(text: str) -> np.ndarray:
    """Code points, 0 for what is in no word."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(_letters()[c], c, 0)


class Trigrams:
    """The distinct trigrams of texts in lower case: of words with two blanks before and one behind."""

    def __init__(self, low: list[str]):
        self.texts = len(low)
        self.row, self.gram = np.zeros(0, np.int64), np.zeros((0, 3), np.uint32)
        at = 0
        parts = []
        while at < len(low):
            to, size = at, 0
            while to < len(low) and (to == at or size + len(low[to]) < CHARS):
                size += len(low[to]) + 2
                to += 1
            parts.append(self._distinct(at, low[at:to]) if to > at + 1 or len(low[at]) <= CHARS else self._long(at, low[at]))
            at = to
        if parts:
            self.row, self.gram = (np.concatenate(x) for x in zip(*parts))
        self.n = np.bincount(self.row, minlength=self.texts)

    def _long(self, at: int, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Of one long text a part at a time; parts end between words."""
        found, a = np.zeros((0, 3), np.uint32), 0
        while a < len(text):
            b = min(a + CHARS, len(text))
            while b < len(text) and text[b].isalnum():
                b += 1
            found = np.unique(np.concatenate([found, self._distinct(0, [text[a:b]])[1]]), axis=0)
            a = b
        return np.full(len(found), at), found

    @staticmethod
    def _distinct(at: int, low: list[str]) -> tuple[np.ndarray, np.ndarray]:
        c = _codes("\n\n".join([*low, ""]))
        row = np.repeat(np.arange(len(low)), [len(x) + 2 for x in low])
        letters = np.unique(c)  # 0 is among them
        place = np.zeros(sys.maxunicode + 1, np.int32)
        place[letters] = np.arange(len(letters))
        c = place[c].astype(np.int64)
        width = len(letters)  # below 2 ** 18, as there are not more letters
        one = np.concatenate([[0], c[:-1]])
        two = np.where(one > 0, np.concatenate([[0, 0], c[:-2]]), 0)
        word = c > 0
        last = word & (np.concatenate([c[1:], [0]]) == 0)
        head = ((row * width + two) * width + one) * width + c
        tail = ((row * width + one) * width + c) * width
        key = np.concatenate([head[word], tail[last]])
        key.sort()
        key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        key, c2 = np.divmod(key, width)
        key, c1 = np.divmod(key, width)
        row, c0 = np.divmod(key, width)
        return row + at, np.column_stack([letters[x] for x in (c0, c1, c2)])


def _number(gram: np.ndarray) -> np.ndarray:
    """A trigram as one number."""
    g = gram.astype(np.int64)
    return (g[:, 0] << 42) + (g[:, 1] << 21) + g[:, 2]


def signal_terms(low: str) -> set[str]:
    """As text.signal_terms, of a text in lower case."""
    out = set(TERM.findall(low))
    for x in [x for x in out if "-" in x or "/" in x]:
        out.update(y for y in [re.sub("[-/]", "", x), *re.split("[-/]", x)] if len(y) >= 2)
    return out


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As whole numbers of 10 ** -digits, halves up."""
    return np.floor(x * 10**digits + 0.5).astype(np.int64)


class Block:
    """Questions and, for each list, the best texts so far by falling key, ties to smaller (document_id, chunk_index)."""

    def __init__(self, questions: list, lists: dict[str, int]):
        self.qids = [q.qid for q in questions]
        self.texts, self.inner = [q.low for q in questions], np.array([q.inner for q in questions])
        self.boosts = np.array([q.flags for q in questions])
        grams, rows = self._matrix([q.grams for q in questions])
        names = [(i, g.replace(" ", "\0")) for g, i in grams.items() if len(g) == 3]
        number = _number(np.array([[ord(c) for c in g] for _, g in names], np.int64).reshape(-1, 3))
        order = np.argsort(number)
        self.grams, self.gram_rows = number[order], rows[np.array([i for i, _ in names], np.int64)[order]]
        self.terms, self.term_rows = self._matrix([q.terms for q in questions])
        self.nq, self.nt = (np.array([len(x) for x in (q[k] for q in questions)]) for k in ("grams", "terms"))
        self.lists = lists
        shape = lambda k: (len(questions), k)
        self.best = {n: {"key": np.full(shape(k), -1), **{c: np.zeros(shape(k), t) for c, t in (("document_id", "i8"), ("chunk_index", "i8"), ("exact", "?"), ("similarity", "f8"), ("cosine", "f8"), ("hits", "i8"))}} for n, k in lists.items()}

    @staticmethod
    def _matrix(sets: list[list[str]]) -> tuple[dict[str, int], np.ndarray]:
        columns = {v: i for i, v in enumerate(dict.fromkeys(v for s in sets for v in s))}
        out = np.zeros((len(columns), len(sets)), np.float32)
        for j, s in enumerate(sets):
            out[[columns[v] for v in s], j] = 1
        return columns, out

    @staticmethod
    def _product(sets: list[set[str]], columns: dict[str, int], rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(sets), len(columns)), np.float32)
        for i, s in enumerate(sets):
            x[i, [columns[v] for v in columns.keys() & s]] = 1
        return np.rint(x @ rows).astype(np.int64)

    def _shared(self, grams: Trigrams) -> np.ndarray:
        """How many trigrams each text shares with each question."""
        x = np.zeros((grams.texts, len(self.grams)), np.float32)
        if len(self.grams):
            number = _number(grams.gram)
            at = np.minimum(np.searchsorted(self.grams, number), len(self.grams) - 1)
            has = self.grams[at] == number
            x[grams.row[has], at[has]] = 1
        return np.rint(x @ self.gram_rows).astype(np.int64)

    def holding(self, low: list[str], n: np.ndarray | None = None) -> list[tuple[int, int]]:
        """(text, question) of the texts that hold a question literally: they have all trigrams of its words but the first and the last."""
        if n is None:
            n = self._shared(Trigrams(low))
        return [(i, j) for i, j in np.argwhere(n >= self.inner).tolist() if self.texts[j] and self.texts[j] in low[i]]

    def add(self, document_id: np.ndarray, chunk_index: np.ndarray, low: list[str], grams: Trigrams, terms: list[set[str]], types: np.ndarray, old: np.ndarray) -> None:
        """Texts in lower case with their trigrams and the terms of their heads."""
        n, nd = self._shared(grams), grams.n[:, None]
        union = self.nq + nd - n
        similar = rounded(n / np.maximum(union, 1), 6)
        exact = np.zeros(n.shape, bool)
        if "keyword" in self.lists:
            exact[tuple(np.array(self.holding(low, n), np.int64).reshape(-1, 2).T)] = True
        measures = {"exact": exact, "similarity": similar / 1e6}
        if {"cosine", "hybrid"} & set(self.lists):
            hits = self._product(terms, self.terms, self.term_rows)
            measures |= {"hits": hits, "cosine": rounded(hits / np.sqrt(np.maximum(self.nt * np.array([len(t) for t in terms])[:, None], 1)), 6) / 1e6}
        keys = {}
        if "keyword" in self.lists:
            keys["keyword"] = np.where(exact, 2_000_000, np.where(similar >= MINIMUM * 1_000_000, similar, -1))
        if "cosine" in self.lists:
            keys["cosine"] = np.where(hits > 0, rounded(measures["cosine"], 6), -1)
        if "hybrid" in self.lists:
            boost = np.zeros(n.shape)
            for i, rule in reversed(list(enumerate(BOOSTS))):
                boost = np.where((types[:, None] >> i & 1 & self.boosts >> i) > 0, rule[2], boost)
            score = SIMILARITY * measures["similarity"] + boost + HIT * hits - OLD * old[:, None]
            keys["hybrid"] = np.where(similar >= MINIMUM * 1_000_000, rounded(score, 7) + 10**7, -1)  # never below zero
        for name, key in keys.items():
            self._keep(name, key.T, document_id, chunk_index, {m: v.T for m, v in measures.items()})

    def _keep(self, name: str, key: np.ndarray, document_id: np.ndarray, chunk_index: np.ndarray, measures: dict[str, np.ndarray]) -> None:
        best, k = self.best[name], self.lists[name]
        who = np.flatnonzero(((key >= best["key"][:, -1:]) & (key >= 0)).any(1))
        if not len(who):
            return
        of = lambda v: np.broadcast_to(v, (len(who), key.shape[1]))
        new = {"key": key[who], "document_id": of(document_id), "chunk_index": of(chunk_index)} | {m: v[who] for m, v in measures.items()}
        both = {m: np.concatenate([best[m][who], v], 1) for m, v in new.items()}
        order = np.lexsort((both["chunk_index"], both["document_id"], -both["key"]))[:, :k]
        for m, v in both.items():
            best[m][who] = np.take_along_axis(v, order, 1)

    def batches(self) -> Iterator[pa.RecordBatch]:
        for name, best in self.best.items():
            q, j = np.nonzero(best["key"] >= 0)
            at = lambda m, t: pa.array(best[m][q, j], t)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(self.qids, np.int64)[q]), pa.array([name] * len(q), pa.string()), at("document_id", pa.int64()), pa.array(best["chunk_index"][q, j].astype(np.int32)), at("exact", pa.bool_()), at("similarity", pa.float64()), at("cosine", pa.float64()), at("hits", pa.int64()), at("key", pa.int64())],
                names=[c.split()[0] for c in FOUND.split(", ")],
            )


def _asked(questions: DataFrame) -> Iterator[list]:
    """Rows of questions (qid, text), a block at a time."""
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    inner = F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), " ")
    rows = questions.select(F.col("qid").cast("long").alias("qid"), F.lower(text).alias("low"), T.trigrams(text).alias("grams"), T.query_terms(text).alias("terms"), F.size(T.trigrams(inner)).alias("inner"), flags(text, 0).alias("flags")).toLocalIterator()
    return iter(lambda: list(islice(rows, QUESTIONS)), [])


def literal_matches(questions: DataFrame, texts: DataFrame) -> DataFrame:
    """(qid, document_id, chunk_index) of all texts that hold a question (qid, text) literally, whatever its case; no text holds an empty one."""
    reachable(questions.sparkSession)
    held = texts.select(F.col("document_id").cast("long"), F.col("chunk_index").cast("int"), F.lower(F.coalesce("content", F.lit(""))).alias("low"))
    schema = "qid long, document_id long, chunk_index int"

    def over(questions_of: list) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = Block(questions_of, {})
            for b in batches:
                for a in range(0, b.num_rows, TEXTS):
                    part = b.slice(a, TEXTS)
                    i, j = np.array(block.holding(part.column(2).to_pylist()), np.int64).reshape(-1, 2).T
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(block.qids, np.int64)[j]), part.column(0).take(pa.array(i)), part.column(1).take(pa.array(i))], names=["qid", "document_id", "chunk_index"])

        return held.mapInArrow(run, schema)

    parts = [over(block) for block in _asked(questions)]
    return reduce(DataFrame.unionByName, parts) if parts else questions.sparkSession.createDataFrame([], schema)


def search(questions: DataFrame, texts: DataFrame, lists: dict[str, int], by_terms_of: Column | None = None) -> DataFrame:
    """FOUND and rank (from 1): for each question (qid, text) and list its best texts (document_id, chunk_index, title, doc_type, content).

    Lists: ``keyword`` (texts that hold the question literally, then by trigram similarity of at
    least MINIMUM), ``cosine`` (of the sets of terms of question and text), ``hybrid``
    (similarity, terms, type and supersession), each with how many rows it takes. Ties go to
    the smaller document_id and chunk_index. Terms are those of the head: title, type and the
    first HEAD characters, or of ``by_terms_of``. Null texts count as empty.
    """
    reachable(questions.sparkSession)
    content = F.coalesce("content", F.lit(""))
    head = F.concat_ws(" ", F.lower("title"), F.lower("doc_type"), F.lower(F.substring(content, 1, HEAD))) if by_terms_of is None else F.lower(by_terms_of)
    held = texts.select(F.col("document_id").cast("long"), F.col("chunk_index").cast("int"), F.lower(content).alias("low"), F.coalesce(head, F.lit("")).alias("head"), F.coalesce(flags(F.col("doc_type"), 1), F.lit(0)).alias("types"), T.contains_any(content, T.SUPERSEDED).alias("old"))

    def over(asked: list[list]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks = [Block(x, lists) for x in asked]
            for b in batches:
                for a in range(0, b.num_rows, TEXTS):
                    d, c, low, head, types, old = b.slice(a, TEXTS).columns
                    low = low.to_pylist()
                    grams, terms = Trigrams(low), [signal_terms(x) for x in head.to_pylist()] if {"cosine", "hybrid"} & set(lists) else []
                    for block in blocks:
                        block.add(d.to_numpy(), c.to_numpy(), low, grams, terms, types.to_numpy(), old.to_numpy(zero_copy_only=False))
            for block in blocks:
                yield from block.batches()

        return known.mapInArrow(run, FOUND)

    known = held.filter("document_id IS NOT NULL AND chunk_index IS NOT NULL")
    asked = _asked(questions)
    parts = [over(some) for some in iter(lambda: list(islice(asked, BLOCKS)), [])]
    found = reduce(DataFrame.unionByName, parts) if parts else questions.sparkSession.createDataFrame([], FOUND)
    rank = F.row_number().over(W.partitionBy("qid", "list").orderBy(F.desc("key"), "document_id", "chunk_index"))
    most = F.create_map(*[F.lit(x) for kv in lists.items() for x in kv])
    return found.withColumn("rank", rank).filter(F.col("rank") <= F.element_at(most, F.col("list")))


def nearest(rows: DataFrame, queries: DataFrame, k: int, group: str | None = None) -> DataFrame:
    """query_id, vec_id, similarity, rank: the k rows (vec_id, embedding) of largest cosine, to 6 digits, for each query (query_id, query); ties to the smaller id.

    ``group``: a column of both that must be equal. Null components count as 0, and the cosine of a
    null, empty or zero vector, or of vectors of two widths, is 0. Rows and queries meet in a grid
    of VECTORS by VECTORS, so no task holds more, however many there are of either.
    """
    reachable(rows.sparkSession)
    wanted = lambda df: F.lit(0).cast("long") if group is None else df[group].cast("long")
    clean = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<double>")), lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    left = rows.select(F.col("vec_id").cast("long").alias("id"), wanted(rows).alias("wanted"), clean("embedding").alias("vec"))
    right = queries.select(F.col("query_id").cast("long").alias("id"), wanted(queries).alias("wanted"), clean("query").alias("vec"))
    across, down = (1 + df.count() // VECTORS for df in (left, right))
    place = lambda n: F.pmod(F.xxhash64("id", F.lit(7)), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    grid = left.select(place(across).alias("a"), every(down).alias("b"), F.lit(False).alias("asked"), "*").unionByName(right.select(every(across).alias("a"), place(down).alias("b"), F.lit(True).alias("asked"), "*"))
    return in_grid(grid, k)


def in_grid(grid: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, similarity, rank of rows and queries (asked) that share a cell: a long, b long, asked, id long, wanted long (equal for those that may meet), vec array<double>."""
    grid = grid.select("a", "b", "asked", "id", "wanted", "vec").filter("wanted IS NOT NULL").repartition("a", "b").sortWithinPartitions("a", "b", "asked")

    def unit(b: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Row numbers and unit vectors, by width."""
        vec = b.column(5)
        sizes, flat, starts = np.diff(vec.offsets.to_numpy()), vec.flatten().to_numpy(), np.cumsum([0, *np.diff(vec.offsets.to_numpy())])
        out = {}
        for w in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == w)
            x = flat[starts[at][:, None] + np.arange(w)] if w else np.zeros((len(at), 0))
            norm = np.sqrt((x * x).sum(1))[:, None]
            out[w] = at, np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        return out

    def best(asked: pa.RecordBatch, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q_wanted = (asked.column(i).to_numpy() for i in (3, 4))
        top = [np.zeros((len(q_ids), 0)), np.zeros((len(q_ids), 0), np.int64)]
        mine = unit(asked)
        for b in held:
            ids, labels = (b.column(i).to_numpy() for i in (3, 4))
            sims = np.zeros((len(q_ids), len(ids)))
            for w, (at, x) in unit(b).items():
                if w in mine:
                    sims[np.ix_(mine[w][0], at)] = mine[w][1] @ x.T
            sims = np.round(sims, 6)
            sims[q_wanted[:, None] != labels[None, :]] = -np.inf
            both = [np.concatenate(x, 1) for x in zip(top, (sims, np.broadcast_to(ids, sims.shape)))]
            order = np.lexsort((both[1], -both[0]))[:, :k]
            top = [np.take_along_axis(x, order, 1) for x in both]
        q, j = np.nonzero(top[0] > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[q]), pa.array(top[1][q, j]), pa.array(top[0][q, j] + 0.0)], names=["query_id", "vec_id", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []
        for b in batches:
            place = np.column_stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            starts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1).tolist()]
            for a, z in zip(starts, [*starts[1:], len(place)]):
                if here != tuple(place[a, :2]):
                    here, held = tuple(place[a, :2]), []
                for c in range(a, z, 1024):
                    part = b.slice(c, min(1024, z - c))
                    if place[a, 2]:
                        yield from best(part, held)
                    else:
                        held.append(part)

    found = grid.mapInArrow(run, "query_id long, vec_id long, similarity double")
    return found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))).filter(F.col("rank") <= k)
