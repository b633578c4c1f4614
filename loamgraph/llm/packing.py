"""Cost-balanced packing of documents into training sequences.

A piece of t tokens costs ``linear * t + quadratic * t ** 2``: attention is quadratic in
the length of a document. Documents go, longest first, to the sequence of the lowest cost
that has room. Work is done in blocks of a bounded number of tokens of one partition, so
nothing is shuffled and no task holds more than a block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loamgraph.llm._common import documents, modest_batches

BLOCK_TOKENS = 4_000_000
#: Room beyond the tokens, as a share of them: padding that leaves costs some freedom to balance.
SLACK = 1 / 128


class _Sequences:
    """Open sequences by room: the cheapest with at least so much of it, by a tree of minima over rooms."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.heaps: dict[int, list[tuple[float, int, int]]] = {}
        self.best: list[tuple[float, int, int] | None] = [None] * (2 * self.size)

    def _renew(self, room: int) -> None:
        best, heap, i = self.best, self.heaps[room], room + self.size
        best[i] = heap[0] if heap else None
        while i > 1:
            i >>= 1
            a, b = best[2 * i], best[2 * i + 1]
            best[i] = a if b is None or a is not None and a < b else b

    def push(self, cost: float, room: int, j: int) -> None:
        heapq.heappush(self.heaps.setdefault(room, []), (cost, -room, j))
        self._renew(room)

    def pop(self, need: int) -> tuple[float, int, int]:
        """Cost, room and number of the cheapest with room for ``need``; if none has it, of the roomiest."""
        best, found = self.best, None
        a, b = need + self.size, 2 * self.size
        while a < b:
            if a & 1:
                if best[a] is not None and (found is None or best[a] < found):
                    found = best[a]
                a += 1
            a, b = a >> 1, b >> 1
        if found is None:
            i = 1
            while i < self.size:
                i = 2 * i + (best[2 * i + 1] is not None)
            found = best[i]
        cost, left, j = found
        heapq.heappop(self.heaps[-left])
        self._renew(-left)
        return cost, -left, j


def assign(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1 / 2048, slack: float = 0.0) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents with these lengths.

    Whole multiples of the capacity are sequences of their own. The rest is spread over as
    many full sequences as it and ``slack`` times it fill; what they cannot take, over
    sequences of 2 ** i tokens, which need no padding. A document is cut only where no
    sequence has room for the whole of it, and then goes to the roomiest.
    """
    pieces, rest, n_seq = [], [], 0
    for d, n in enumerate(lengths):
        for k in range(n // capacity):
            pieces.append((d, k * capacity, capacity, n_seq, 0))
            n_seq += 1
        if n % capacity:
            rest.append((n % capacity, d))
    total = sum(r for r, _ in rest)
    full = int(total * (1 + slack)) // capacity
    left_over = max(0, total - full * capacity)
    room = [capacity] * full + [1 << i for i in range(capacity.bit_length()) if left_over >> i & 1]
    used = [0] * len(room)
    open_ = _Sequences(capacity)
    for j, c in enumerate(room):
        open_.push(0.0, c, j)
    for r, d in sorted(rest, key=lambda x: (-x[0], x[1])):
        start = lengths[d] - r
        while r:
            cost, left, j = open_.pop(r)
            n = min(r, left)
            pieces.append((d, start, n, n_seq + j, used[j]))
            used[j] += n
            start, r = start + n, r - n
            if n < left:
                open_.push(cost + linear * n + quadratic * n * n, left - n, j)
    return pieces


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int | None = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Pack whole texts into sequences of ``capacity`` tokens: one row for each piece.

    doc_id, start (the document's ids before the piece), length, ids (little-endian unsigned
    32-bit), doc_tokens, sequence_id, offset. A null text is empty and gives its end id
    only; with no end id, empty documents give no piece. Rows with equal or null doc_ids are
    packed one by one. Sequences are padded to ``capacity`` tokens, by SLACK of them on average,
    but for the last few of a block, which hold a power of two.
    """
    modest_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from loamgraph.llm.bpe import piece_encoder

        encoder, first = piece_encoder(tokenizer), TaskContext.get().partitionId() << 36
        end = b"" if end_id is None else np.array([end_id], encoder.dtype).tobytes()
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal first
            made = assign([len(x) for x in ids], capacity, slack=SLACK)
            for at in range(0, len(made), 2000):
                part = made[at : at + 2000]
                columns = zip(*((doc_ids[d], s, n, ids[d][s : s + n].astype("<u4").tobytes(), len(ids[d]), first + q, o) for d, s, n, q, o in part))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
            first += 1 + max((p[3] for p in made), default=-1)
            doc_ids.clear()
            ids.clear()

        held = 0
        for b in batches:
            doc_ids += b.column(0).to_pylist()
            new = [np.frombuffer(x + end, encoder.dtype) for x in encoder.encode(b.column(1).to_pylist())]
            ids += new
            held += sum(map(len, new))
            if held >= BLOCK_TOKENS:
                yield from block()
                held = 0
        yield from block()

    return documents(docs, text, doc_id).mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.selectExpr("doc_id", "start", "length", "crc32(ids) AS ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json")))
