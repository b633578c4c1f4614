"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed into the
fewest phrases that occur in that text, greedily: a phrase goes on while the automaton has
a transition. Few phrases per character mean that the texts are alike; the language that
needs fewest wins, each phrase normalised by what it costs to point into that language's text,
the logarithm of its length.

Letters are lower-cased and runs of anything else count as one blank. Whole texts are
parsed, in segments of ``SEGMENT`` characters at whose ends a phrase ends, so that many
segments advance in step, one character at a time, as vector operations.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamgraph.llm._common import crc32_mod, modest_batches, resident

SEGMENT = 512
#: The classifier is fitted on at most so many labelled documents and characters of each language, chosen by a hash of their ids.
SAMPLE_ROWS, SAMPLE_CHARS = 96, 120_000
UNDETERMINED = "und"


@functools.lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Code point to code point of the lower-case letter, 32 for all that is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x33480):
        if (x := chr(c)).isalpha():
            out[c] = ord(low) if len(low := x.lower()) == 1 else c
    return out


def letters(text: str) -> np.ndarray:
    """Letters in lower case with single blanks between words, as code points."""
    x = letter_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    keep = x != 32
    keep[1:] |= keep[:-1].copy()
    return x[keep]


class Automaton:
    """Suffix automaton of a text over small integers, as a table: target state, or the complement of the root's target where a phrase ends."""

    def __init__(self, text: list[int], width: int):
        nexts, link, length = [{}], [-1], [0]
        last = 0
        for c in text:
            cur = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in nexts[p]:
                nexts[p][c] = cur
                p = link[p]
            if p != -1:
                q = nexts[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nexts)
                    nexts.append(dict(nexts[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[cur] = clone
                    while p != -1 and nexts[p].get(c) == q:
                        nexts[p][c] = clone
                        p = link[p]
            last = cur
        table = np.full((len(nexts), width), -1, np.int32)
        for s, n in enumerate(nexts):
            if n:
                table[s, list(n)] = list(n.values())
        root = np.maximum(table[0], 0)
        self.table = np.where(table >= 0, table * width, ~(root * width)[None, :]).astype(np.int32).ravel()


class Model:
    """Automata of all languages. Symbol 0 is what no sample holds, symbol 1 pads."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        texts = [np.concatenate([np.append(letters(x), 32) for x in samples[k]] or [np.zeros(0, np.uint32)]).astype(np.uint32) for k in self.languages]
        alphabet = np.unique(np.concatenate([*texts, np.array([32], np.uint32)]))
        self.symbols = np.zeros(0x110000, np.int16)
        self.symbols[alphabet] = np.arange(2, len(alphabet) + 2)
        self.automata = [Automaton(self.symbols[x].tolist(), len(alphabet) + 2) for x in texts]
        # Of a phrase: a place in the sample, but no less than a letter by itself, which any language could give.
        self.cost = np.log2(np.maximum([len(x) for x in texts], len(alphabet)) + 2)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases by text and language, and characters by text."""
        coded = [self.symbols[letters(x)] for x in texts]
        sizes = np.array([len(x) for x in coded], np.int64)
        counts = np.zeros((len(texts), len(self.automata)), np.int64)
        parts = [(i, a) for i, x in enumerate(coded) for a in range(0, len(x), SEGMENT)]
        parts.sort(key=lambda p: p[1] - len(coded[p[0]]))  # long segments first
        parts.sort(key=lambda p: -min(SEGMENT, len(coded[p[0]]) - p[1]))
        for at in range(0, len(parts), 4096):
            some = parts[at : at + 4096]
            owner = np.array([i for i, _ in some])
            length = np.array([min(SEGMENT, sizes[i] - a) for i, a in some])
            grid = np.ones((len(some), int(length[0])), np.int32)
            for k, (i, a) in enumerate(some):
                grid[k, : length[k]] = coded[i][a : a + SEGMENT]
            grid = np.ascontiguousarray(grid.T)
            live = np.searchsorted(-length, -np.arange(grid.shape[0]), side="left")  # segments longer than each step
            for j, automaton in enumerate(self.automata):
                state, ended = np.zeros(len(some), np.int32), np.ones(len(some), np.int32)
                table = automaton.table
                for step, n in zip(grid, live.tolist()):
                    to = table.take(state[:n] + step[:n])
                    sign = to >> 31
                    ended[:n] -= sign
                    state[:n] = to ^ sign
                counts[:, j] += np.bincount(owner, ended, len(texts)).astype(np.int64)
        return counts, sizes

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score: how far the best needs less than the next, from 0 to 1."""
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        counts, sizes = self.phrases([x or "" for x in texts])
        bits = counts * self.cost
        best = bits.argmin(1)  # ties: the first by name
        ordered = np.sort(bits, 1)
        if len(self.languages) == 1:
            score = 1 - counts[:, 0] / np.maximum(sizes + 1, 1)
        else:
            score = 1 - ordered[:, 0] / np.maximum(ordered[:, 1], 1)
        score = np.where(sizes > 0, np.clip(score, 0, 1), 0.0)
        return [self.languages[k] if n else UNDETERMINED for k, n in zip(best.tolist(), sizes.tolist())], score


def _model(samples: bytes) -> Model:
    return resident(("language", samples), lambda: Model(pickle.loads(samples)))


def sample(docs: DataFrame, text: str, lang: str, doc_id: str) -> dict[str, list[str]]:
    """Labelled texts of each language, at most SAMPLE_ROWS and SAMPLE_CHARS of them; a hash of doc_id chooses. Of a longer text the first part is learned from."""
    first = W.partitionBy("lang").orderBy("h", "doc_id", "t")
    labelled = docs.select(F.col(lang).alias("lang"), F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id).alias("h"), F.xxhash64(text).alias("t"), F.col(text).alias("text")).filter("lang IS NOT NULL AND doc_id IS NOT NULL AND text <> ''")
    ids = labelled.drop("text").withColumn("k", F.row_number().over(first)).filter(F.col("k") <= SAMPLE_ROWS).select("doc_id").distinct().collect()
    if not ids:
        return {}
    # At most SAMPLE_ROWS of a language, however often an id repeats.
    rows = labelled.filter(F.col("doc_id").isin(sorted(r.doc_id for r in ids))).withColumn("text", F.substring("text", 1, SAMPLE_CHARS)).withColumn("k", F.row_number().over(first)).filter(F.col("k") <= SAMPLE_ROWS).select("lang", "k", "text")
    out: dict[str, list[str]] = {}
    room: dict[str, int] = {}
    for r in sorted(rows.collect()):
        left = room.setdefault(r.lang, SAMPLE_CHARS)
        if left:
            out.setdefault(r.lang, []).append(r.text[:left])
            room[r.lang] = max(0, left - len(r.text))
    return out


def identify(docs: DataFrame, training: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Predict the language of every whole text: doc_id, lang_pred, score, and the columns in ``keep``.

    ``training`` holds labelled documents; rows with a null label, text or id are not learned
    from. A null, empty or letterless text is ``und`` with score 0, as is every text where
    nothing could be learned. Equal phrase counts go to the first language by name. The same
    text gives the same answer wherever it stands, so repeated rows stay as they are.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    blob = spark.sparkContext.broadcast(pickle.dumps(sample(training, text, lang, doc_id)))
    source = docs.select(F.col(doc_id).alias("__0"), F.col(text).alias("__1"), *[F.col(c).alias(f"__{i + 2}") for i, c in enumerate(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(blob.value)
        for b in batches:
            got, score = model.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(got, pa.string()), pa.array(score, pa.float64())], names=["doc_id", *keep, "lang_pred", "score"])

    schema = ", ".join([f"doc_id {docs.schema[doc_id].dataType.simpleString()}", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string", "score double"])
    return source.mapInArrow(run, schema)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(crc32_mod("doc_id", 3) == 1, F.lit(False))
    return identify(docs, docs.filter(~held_out)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
