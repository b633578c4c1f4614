"""Token-id files: Elias-Fano document boundaries over one concatenated id array.

A shard holds a run of documents in ascending doc_id order::

    magic "EFIDS1\\0\\0" | header: 8 x uint64 | doc ids int64[n] | null flags, a bit each
    | low bits | high bits | select samples uint32 | ids uint16 or uint32

The n + 1 boundaries (0 = first, n_tokens = last) are stored in 2 + log2(n_tokens / n)
bits each: the low bits verbatim, the high bits in unary. Every 256th one-bit's place is
sampled, so that ``offset(i)`` scans a few words only and no table of 64-bit offsets exists.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.llm._common import documents, modest_batches, shared_dir

MAGIC = b"EFIDS1\0\0"
SAMPLE = 256


class EliasFano:
    """A non-decreasing sequence of unsigned integers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.packbits(((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros((int(places[-1]) + 1 if n else 0), np.uint8)
        flags[places] = 1
        return cls(n, bits, low, np.packbits(flags, bitorder="little"), places[::SAMPLE].astype("<u4"))

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for b in range(self.low_bits):
            at = i * self.low_bits + b
            out |= ((self.low[at >> 3] >> (at & 7)) & 1).astype(np.int64) << b
        return out

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = place >> 3
        word = int(self.high[byte]) & (0xFF << (place & 7))
        while left >= word.bit_count():
            left -= word.bit_count()
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        place = 8 * byte + (word & -word).bit_length() - 1
        return ((place - i) << self.low_bits) | int(self._low(np.array([i], np.int64))[0])

    def window(self, i: int, k: int) -> np.ndarray:
        """Values i to i + k - 1, from the sample before them on; no more than these are ever expanded."""
        place = int(self.samples[i // SAMPLE])
        start, need = place >> 3, i % SAMPLE + k
        size = need
        while True:
            places = np.flatnonzero(np.unpackbits(self.high[start : start + size], bitorder="little")) + 8 * start
            places = places[np.searchsorted(places, place) :]
            if len(places) >= need or start + size >= len(self.high):
                break
            size *= 2
        at = np.arange(i, i + k)
        return ((places[i % SAMPLE : need] - at) << self.low_bits) | self._low(at)


def dump(doc_ids: list[int | None], lengths: np.ndarray, ids: bytes, width: int) -> bytes:
    """The bytes of a shard."""
    ef = EliasFano.build(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]))
    nulls = np.packbits(np.array([x is None for x in doc_ids], np.uint8), bitorder="little")
    head = struct.pack("<8Q", len(doc_ids), len(ids) // width, width, ef.low_bits, len(nulls), len(ef.low), len(ef.high), len(ef.samples))
    return b"".join([MAGIC, head, np.array([x or 0 for x in doc_ids], "<i8").tobytes(), nulls.tobytes(), ef.low.tobytes(), ef.high.tobytes(), ef.samples.tobytes(), ids])


class Shard:
    """A shard's documents, from its bytes."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token-id file")
        n, self.n_tokens, width, bits, n_nulls, n_low, n_high, n_samples = struct.unpack_from("<8Q", data, 8)
        at = 72

        def take(count: int, dtype: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype, count, at)
            at += out.nbytes
            return out

        ids = take(n, "<i8")
        nulls = np.unpackbits(take(n_nulls, "u1"), bitorder="little")[:n]
        self.doc_ids = [None if z else int(x) for x, z in zip(ids, nulls)]
        self.bounds = EliasFano(n + 1, bits, take(n_low, "u1"), take(n_high, "u1"), take(n_samples, "<u4"))
        self.ids = take(self.n_tokens, "<u2" if width == 2 else "<u4")

    def tokens(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        for at in range(0, len(self.doc_ids), SAMPLE):
            some = self.doc_ids[at : at + SAMPLE]
            ends = self.bounds.window(at, len(some) + 1).tolist()
            for d, a, b in zip(some, ends, ends[1:]):
                yield d, a, self.ids[a:b]


def put(path: str, data: bytes) -> None:
    """Write whole or not at all: a task that runs twice leaves the same file."""
    import os
    import uuid

    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    part = f"{at}.{os.getpid()}-{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, at)


def get(path: str) -> bytes:
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_file(at) as f:
        return f.read()


def write(docs: DataFrame, tokenizer: str, out: str, end_id: int | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Write whole texts, encoded, as shards below ``out``, in ascending doc_id order; return the manifest.

    docs is range-partitioned by doc_id, then a hash of the text (texts are shuffled, not ids,
    so that nothing is encoded twice), and each partition becomes a shard; so one id that many
    rows share is spread over shards. Manifest: shard, path, n_docs, n_tokens, start (ids of all
    shards before it). A null text is empty; null doc_ids come first; rows that share a doc_id
    are in the order of that hash, then of the text; an empty table gives no shards.
    """
    spark = docs.sparkSession
    modest_batches(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from loamgraph.llm.bpe import piece_encoder

        encoder = piece_encoder(tokenizer)
        end = b"" if end_id is None else np.array([end_id], encoder.dtype).tobytes()
        doc_ids, lengths, ids = [], [], io.BytesIO()
        for b in batches:
            doc_ids += b.column(0).to_pylist()
            for x in encoder.encode(b.column(1).to_pylist()):
                lengths.append((ids.write(x) + ids.write(end)) // encoder.dtype.itemsize)
        if doc_ids:
            k = TaskContext.get().partitionId()
            put(path := f"{out}/shard-{k:07d}.efids", dump(doc_ids, np.array(lengths, np.int64), ids.getvalue(), encoder.dtype.itemsize))
            yield pa.RecordBatch.from_pydict({"shard": [k], "path": [path], "n_docs": [len(doc_ids)], "n_tokens": [sum(lengths)]}, pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    laid = documents(docs, text, doc_id).withColumn("h", F.xxhash64("text"))
    laid = laid.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    # One small row for each shard comes to the driver, which starts the read from it.
    rows = sorted(laid.mapInArrow(encode, "shard long, path string, n_docs long, n_tokens long").collect())
    starts = np.cumsum([0, *(r.n_tokens for r in rows)]).tolist()
    return spark.createDataFrame([(*r, s) for r, s in zip(rows, starts)], "shard long, path string, n_docs long, n_tokens long, start long")


def scan(manifest: DataFrame) -> DataFrame:
    """Read shards: doc_id, start (ids of all documents before it), ids (little-endian, unsigned 32-bit)."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows: list[tuple] = []
                for d, a, ids in Shard(get(path)):
                    rows.append((d, start + a, ids.astype("<u4").tobytes()))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    n = max(1, manifest.count())
    return manifest.select("path", "start").repartition(n).mapInArrow(load, "doc_id long, start long, ids binary")


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of scan()'s rows."""
    return scanned.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(scan(write(docs, public_tokenizers.path("byte_bpe_50k.json"), shared_dir(spark), end_id=2)))
