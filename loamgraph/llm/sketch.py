"""A counter sketch of fixed size: which hashes may occur in many places.

64-bit hashes fall into 2 ** SLOT_BITS counters by their top bits. Tasks send the counters they
hit as differences of one or two bytes each, which is far less than the hashes themselves;
counters are added up by parts, and those that reach a number set a bit of a filter. A hash
that occurs so often is never missed, whatever the size of the input; the fuller the sketch,
the more others pass, so what passes is counted exactly by whoever asks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loamgraph.llm._common import Bits

SLOT_BITS, PART_BITS = 28, 22
SCHEMA = "part int, slots binary"
#: Counters that a task gathers before it sends them.
HELD = 2_000_000


def slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.uint32)


def has(bits: Bits, h: np.ndarray) -> np.ndarray:
    """Which of these hashes pass the filter."""
    s = slots(h)
    return (bits.bits[s >> 3] >> (s & 7).astype(np.uint8)) & 1 > 0


def _written(x: np.ndarray) -> bytes:
    """Sorted numbers as steps of one byte or two, the largest step of a kind standing for no number but the way on."""
    d = np.diff(x, prepend=np.zeros(1, x.dtype)).astype(np.int64)
    one, two = d // 255, d // 65535
    small = len(d) + one.sum() <= 2 * (len(d) + two.sum())
    top, more = (255, one) if small else (65535, two)
    out = np.full(len(d) + int(more.sum()), top, np.uint8 if small else np.dtype("<u2"))
    out[np.cumsum(more + 1) - 1] = d - more * top
    return (b"\1" if small else b"\2") + out.tobytes()


def _numbers(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, np.uint8 if data[0] == 1 else "<u2", offset=1)
    return np.cumsum(steps, dtype=np.int64)[steps != (255 if data[0] == 1 else 65535)]


def send(hashes: Iterable[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA for all these (kind, hashes), each hash counted as often as it comes. Each kind, from 0, is a sketch of its own."""
    held: dict[int, list[np.ndarray]] = {}
    size: dict[int, int] = {}
    parts = 1 << (SLOT_BITS - PART_BITS)

    def rows(kind: int) -> pa.RecordBatch:
        x = np.sort(np.concatenate(held.pop(kind)))
        del size[kind]
        edge = np.searchsorted(x, np.arange(parts + 1, dtype=np.uint64) << np.uint64(PART_BITS))
        some = [k for k in range(parts) if edge[k] < edge[k + 1]]
        blobs = [_written(x[edge[k] : edge[k + 1]] - np.uint32(k << PART_BITS)) for k in some]
        return pa.RecordBatch.from_arrays([pa.array([kind * parts + k for k in some], pa.int32()), pa.array(blobs, pa.binary())], names=["part", "slots"])

    for kind, h in hashes:
        held.setdefault(kind, []).append(slots(h))
        size[kind] = size.get(kind, 0) + len(h)
        if size[kind] >= HELD:
            yield rows(kind)
    for kind in list(held):
        yield rows(kind)


def frequent(sent: DataFrame, *least: tuple[int, int]) -> list[Bits]:
    """For each (kind, number): the filter of the counters of this kind that reach this number."""
    parts = 1 << (SLOT_BITS - PART_BITS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, n = None, [], 0
        counts = np.zeros(0, np.int64)

        def flush() -> None:
            nonlocal counts, held, n
            if held:
                counts += np.bincount(np.concatenate(held), minlength=1 << PART_BITS)
                held, n = [], 0

        def done() -> pa.RecordBatch:
            flush()
            some = [i for i, (kind, _) in enumerate(least) if kind == part // parts]
            bits = [pa.compress(np.packbits(counts >= least[i][1], bitorder="little"), codec="zstd", asbytes=True) for i in some]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([part % parts] * len(some), pa.int32()), pa.array(bits, pa.binary())], names=["i", "part", "bits"])

        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if p != part:
                    if part is not None:
                        yield done()
                    part, counts = p, np.zeros(1 << PART_BITS, np.int64)
                held.append(_numbers(data))
                n += len(held[-1])
                if n > 4 * HELD:
                    flush()
        if part is not None:
            yield done()

    # Filters come to the driver compressed: of a fixed size at most, mostly far less.
    rows = sent.repartition("part").sortWithinPartitions("part").mapInArrow(add, "i int, part int, bits binary").collect()
    out = [np.zeros(1 << (SLOT_BITS - 3), np.uint8) for _ in least]
    size = 1 << (PART_BITS - 3)
    for r in rows:
        out[r.i][r.part * size : (r.part + 1) * size] = np.frombuffer(pa.decompress(r.bits, decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    return [Bits(x) for x in out]
