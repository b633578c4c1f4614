"""Byte-pair encoding and decoding with content-defined chunk reuse.

A rolling hash over 16 characters cuts texts into chunks, at the same places wherever the
same passage stands. A chunk that several documents share is encoded once for each Python
worker while a bounded memo lasts. The ends of a chunk may split a pre-token, so each join
is repaired: the stretch around it is encoded anew out to the nearest blank on either side.
The library then encodes the repaired stretch together with the words on both sides: if these
ids are not exactly the spliced ones, the stretch is widened until they are, at last to the
whole text. Texts that may hold an added token go to the library as they are.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.llm._common import documents, modest_batches, resident
from loamgraph.llm.bpe import added_token_hint

#: A cut on average every 2 ** 9 characters.
CUT_BITS = 9
#: Bounds of the memos: characters of chunks, and words.
MEMO_CHARS, MEMO_WORDS, WORD_CHARS = 24_000_000, 500_000, 8_000_000
#: Words on either side of a join that must agree, tried in turn before the whole text.
AROUND = (1, 4, 16)
BLANKS = " \n\t"
#: Missing words are encoded so many at a time, as one text.
JOINED = 2000


def cuts(text: str) -> list[int]:
    """Ends of the chunks."""
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    for s in (1, 2, 4, 8):
        h[s:] += h[:-s] << np.uint32(s)  # the right side is a copy: windows of 2, 4, 8, 16
    found = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1
    out = found[found >= 16].tolist()
    if text and (not out or out[-1] != len(text)):
        out.append(len(text))
    return out


def _around(text: str, at: int, words: int) -> str:
    """The stretch without blanks at this place and so many words on either side."""
    a = b = at
    for k in range(words + 1):
        while a and k and text[a - 1] in BLANKS:
            a -= 1
        a = max(text.rfind(c, 0, a) for c in BLANKS) + 1
        while b < len(text) and k and text[b] in BLANKS:
            b += 1
        b = min((p for p in (text.find(c, b) for c in BLANKS) if p >= 0), default=len(text))
    return text[a:b]


class ChunkEncoder:
    """With ``added_tokens``, as in all operators, those in texts are recognised, as the library does unless told not to."""

    def __init__(self, path: str, added_tokens: bool = False):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        t = self.tokenizer = Tokenizer.from_file(path)
        t.encode_special_tokens = not added_tokens
        self._special = added_token_hint(t).search if added_tokens else lambda x: None
        t.no_truncation()
        t.no_padding()
        self.vocabulary = np.array([t.id_to_token(i) or "" for i in range(t.get_vocab_size())], object)
        self._chunks: dict[str, tuple[str, bytes | None, str]] = {}
        self._words: dict[str, bytes] = {"": b""}
        self._agreed: set[str] = set()
        self._chars = self._word_chars = 0
        suffix = getattr(t.model, "end_of_word_suffix", None)
        self._ends = np.array([bool(suffix) and x.endswith(suffix) for x in self.vocabulary])

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[str]) -> None:
        """Encode new words (all that stands between two blanks), those of letters only as one text: each of them is one pre-token, which the last of its ids tells."""
        plain, rest = [], []
        for w in words:
            (plain if w.isalpha() else rest).append(w)
        for at in range(0, len(plain), JOINED):
            part = plain[at : at + JOINED]
            data = self._ids([" ".join(part)])[0]
            stops = ((np.flatnonzero(self._ends[np.frombuffer(data, "<u4")]) + 1) * 4).tolist()
            if len(stops) != len(part):
                rest += part
                continue
            start = 0
            for w, stop in zip(part, stops):
                self._words[w] = data[start:stop]
                start = stop
        self._words.update(zip(rest, self._ids(rest) if rest else ()))
        self._word_chars += sum(map(len, words))

    def _encode_words(self, rows: list[list[str]]) -> list[bytes]:
        self._learn(set().union(*rows).difference(self._words))
        get = self._words.__getitem__
        return [b"".join(map(get, row)) for row in rows]

    def _split(self, chunk: str) -> tuple[str, str | None, str]:
        """What precedes the first blank, what lies from the first to the last, what follows."""
        places = [p for p in map(chunk.find, BLANKS) if p >= 0]
        if not places:
            return chunk, None, ""
        first, last = min(places), max(map(chunk.rfind, BLANKS))
        return chunk[:first], chunk[first : last + 1], chunk[last + 1 :]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, little-endian unsigned 32-bit."""
        whole = [i for i, x in enumerate(texts) if self._special(x)]
        if whole:
            by_library = dict(zip(whole, self._ids([texts[i] for i in whole])))
            rest = iter(self._encode([x for i, x in enumerate(texts) if i not in by_library]))
            return [by_library[i] if i in by_library else next(rest) for i in range(len(texts))]
        return self._encode(texts)

    def _encode(self, texts: list[str]) -> list[bytes]:
        if self._chars > MEMO_CHARS:
            self._chunks.clear()
            self._chars = 0
        if len(self._words) > MEMO_WORDS or self._word_chars > WORD_CHARS:
            self._words = {"": b""}
            self._agreed.clear()
            self._word_chars = 0
        docs = []
        for x in texts:
            ends = cuts(x)
            docs.append([x[a:b] for a, b in zip([0, *ends], ends)])
        new = list({c for d in docs for c in d if c not in self._chunks})
        parts = [self._split(c) for c in new]
        cores = iter(self._encode_words([p[1].replace("\n", " ").replace("\t", " ").split(" ") for p in parts if p[1] is not None]))
        for c, (head, core, tail) in zip(new, parts):
            self._chunks[c] = (head, None if core is None else next(cores), tail)
            self._chars += len(c)
        # Each document as core, join, core, ...: joins are strings without blanks.
        laid: list[list[bytes | str]] = []
        for d in docs:
            row: list[bytes | str] = []
            join: list[str] = []
            for c in d:
                head, core, tail = self._chunks[c]
                join.append(head)
                if core is not None:
                    row += ["".join(join), core]
                    join = [tail]
            row.append("".join(join))
            laid.append(row)
        self._learn({x for row in laid for x in row if isinstance(x, str) and x not in self._words})
        out = [b"".join([self._words[x] if isinstance(x, str) else x for x in row]) for row in laid]
        wrong = self._disagreeing(texts, docs)
        for i, x in zip(wrong, self._ids([texts[i] for i in wrong]) if wrong else ()):
            out[i] = x
        return out

    def _disagreeing(self, texts: list[str], docs: list[list[str]]) -> list[int]:
        """Texts of which some join does not agree with the library, however wide it is taken."""
        open_ = []
        for i, (text, chunks) in enumerate(zip(texts, docs)):
            at = 0
            for c in chunks[:-1]:
                at += len(c)
                open_.append((i, at))
        for n in AROUND:
            windows = [_around(texts[i], at, n) for i, at in open_]
            new = list(dict.fromkeys(w for w in windows if w not in self._agreed))
            words = [w.replace("\n", " ").replace("\t", " ").split(" ") for w in new]
            self._learn(set().union(*words).difference(self._words))
            for w, parts, ids in zip(new, words, self._ids(new) if new else ()):
                if b"".join([self._words[x] for x in parts]) == ids:
                    self._agreed.add(w)
                    self._word_chars += len(w)
            open_ = [x for x, w in zip(open_, windows) if w not in self._agreed]
            if not open_:
                return []
        return sorted({i for i, _ in open_})

    def decode(self, ids: bytes) -> str:
        """As the library's decode for a vocabulary without a decoder: tokens with blanks between, special ones too."""
        if self.tokenizer.decoder is not None:
            return self.tokenizer.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        return " ".join(self.vocabulary[np.frombuffer(ids, "<u4")].tolist())


def chunk_encoder(path: str) -> ChunkEncoder:
    return resident(("chunks", path), lambda: ChunkEncoder(path, added_tokens=True))


def encode(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and, if asked for, the decoded text.

    Null and empty texts have no ids. Rows are encoded one by one: null and repeated doc_ids
    stay as they are.
    """
    modest_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(tokenizer)
        for b in batches:
            ids = encoder.encode(b.column(1).to_pylist())
            columns = {"doc_id": b.column(0), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}
            if decoded:
                columns["decoded"] = pa.array([encoder.decode(x) for x in ids], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return documents(docs, text, doc_id).mapInArrow(run, "doc_id long, n_tokens long, ids binary" + ", decoded string" * decoded)


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and the decoded text of rows of ids; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "decoded": pa.array([None if x is None else encoder.decode(x) for x in b.column(1).to_pylist()], pa.string())})

    return encoded.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, "doc_id long, decoded string")


def op3_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
