"""Best-fit packing of documents into as few sequences as it can, planned on a histogram of lengths.

Best-fit decreasing needs to know how many pieces of each length there are, not which: the
plan is made of at most ``capacity`` counts. Sequences that are filled alike are one group of
the plan, so its size is bounded by the capacity, whatever the number of documents. Each
piece then takes its slot by its rank among the pieces of its length: a number within its
partition plus the pieces of that length in earlier partitions. A length that a third of all
pieces have is dealt over partitions like any other.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamgraph.llm._common import documents, stored
from loamgraph.session import reachable

CAPACITY = 2048
#: So many characters of text are encoded at once, but for a single longer text.
CHARS = 4_000_000

SLOTS = "length long, first_rank long, last_rank long, per_sequence long, first_sequence long, first_offset long"
PIECES = "doc_id long, piece int, start long, length long, ids binary, doc_tokens long, part long, nth long"


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (see SLOTS) for so many pieces of each length, as best-fit decreasing lays them.

    A piece goes to the fullest sequence with room for it. As that sequence stays the fullest
    with room while another piece of the length fits, sequences of equal room are filled
    alike, many at a time. Each length splits at most two groups, so there are at most
    3 * capacity groups, each with slots of fewer than sqrt(2 * capacity) lengths.
    """
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by room: first sequence, how many
    rooms = 0  # a bit for each room that some group has
    slots, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            fits = rooms >> length
            room = length + (fits & -fits).bit_length() - 1 if fits else capacity
            if not fits:
                n = -(-left // (capacity // length))
                groups[capacity].append((sequences, n))
                rooms |= 1 << capacity
                sequences += n
            first, n = groups[room].pop()
            most = room // length
            for k, take in ((most, min(n, left // most)), (left % most, 1)):
                if not k or not take or not n or k > left:
                    continue
                slots.append((length, rank, rank + k * take, k, first, capacity - room))
                rank, left = rank + k * take, left - k * take
                groups[room - k * length].append((first, take))
                rooms |= 1 << room - k * length
                first, n = first + take, n - take
            if n:
                groups[room].append((first, n))
            if not groups[room]:
                rooms &= ~(1 << room)
    return slots


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int | None = 0, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The columns of PIECES: whole texts as ids (little-endian unsigned 32-bit), cut only where longer than ``capacity``; ``nth`` counts the pieces of a length in their partition from 0."""
    reachable(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("part", pa.int64()), ("nth", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from loamgraph.llm import word_bpe

        encode = word_bpe.encoder(tokenizer)
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        wide = encode.dtype.itemsize == 4

        def rows(ids_of: list[int | None], texts: list[str]) -> Iterator[pa.RecordBatch]:
            out = []
            for d, data in zip(ids_of, encode.encode(texts)):
                data = (data if wide else np.frombuffer(data, encode.dtype).astype("<u4").tobytes()) + end
                total = len(data) // 4
                for k, at in enumerate(range(0, total, capacity)):
                    n = min(capacity, total - at)
                    out.append((d, k, at, n, data[at * 4 : (at + n) * 4], total, part, seen[n]))
                    seen[n] += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        for b in batches:
            held_ids, held, chars = [], [], 0
            for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held_ids.append(d)
                held.append(x)
                chars += len(x)
                if chars >= CHARS:
                    yield from rows(held_ids, held)
                    held_ids, held, chars = [], [], 0
            yield from rows(held_ids, held)

    return documents(docs, text, doc_id).mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int | None = 0, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Pack whole texts into as few sequences of ``capacity`` tokens as best-fit decreasing needs: one row for each piece.

    doc_id, piece (from 0), start (the document's ids before the piece), length, ids
    (little-endian unsigned 32-bit), doc_tokens, sequence_id (from 0, without gaps), offset.
    Documents of more than ``capacity`` tokens are cut into pieces of that many, the last of
    which may be shorter; others stay whole. A null text is empty and gives its end id only;
    with no end id, empty documents give no piece. Rows with equal or null doc_ids are packed
    one by one, other columns are dropped, an empty table gives no rows.
    """
    spark = docs.sparkSession
    made = stored(pieces(docs, tokenizer, capacity, end_id, text, doc_id))
    counts = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    earlier = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    bases = counts.select("part", "length", F.coalesce(earlier, F.lit(0)).alias("base"))
    slots = F.broadcast(spark.createDataFrame(plan(histogram, capacity), SLOTS))  # bounded by the capacity, see plan()
    ranked = made.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    placed = ranked.join(slots, (ranked["length"] == slots["length"]) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("last_rank"))).drop(slots["length"])
    return placed.selectExpr("doc_id", "piece", "start", "length", "ids", "doc_tokens", "first_sequence + (rank - first_rank) div per_sequence AS sequence_id", "first_offset + (rank - first_rank) % per_sequence * length AS offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, n_tokens, doc_ids: the pieces of pack() laid one after the other."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))  # a sequence has at most its capacity of pieces
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.aggregate("p.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"), F.col("p.doc_id").alias("doc_ids")).withColumn("n_tokens", (F.length("ids") / 4).cast("long"))


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.selectExpr("doc_id", "piece", "start", "length", "crc32(ids) AS ids_crc32", "doc_tokens", "sequence_id", "offset")
