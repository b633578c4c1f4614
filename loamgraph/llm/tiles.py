"""Vectors packed into tiles: rows of at most so many vectors, as little-endian arrays in bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgraph.session import reachable


def usable(column: str) -> Column:
    """Neither null nor empty, and all components finite."""
    c = F.col(column)
    return c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def matrix(values: list[list[float]], dtype: str) -> np.ndarray:
    """A row for each vector; shorter ones are padded with zeros."""
    width = max(map(len, values), default=0)
    if all(len(v) == width for v in values):
        return np.array(values, dtype).reshape(len(values), width)
    out = np.zeros((len(values), width), dtype)
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


def wider(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def tiles(vectors: DataFrame, rows: int, order: list[str], dtype: str = "<f8") -> DataFrame:
    """(tile, n, lo, hi, ids, weights, data) of (id, weight, key, vec) rows, laid in the given order.

    Rows are range-partitioned by ``order``; end it with a column without ties, so that equal
    vectors spread over partitions. lo and hi are the least and largest ``key`` of a tile.
    """
    reachable(vectors.sparkSession)
    # Arrow batches of at most ``rows`` make up tiles of exactly so many, but for a partition's last.
    schema = pa.schema([("tile", pa.int64()), ("n", pa.int64()), ("lo", pa.float64()), ("hi", pa.float64()), ("ids", pa.binary()), ("weights", pa.binary()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def cut(everything: bool) -> Iterator[pa.RecordBatch]:
            nonlocal at, held
            table = pa.Table.from_batches(held)
            n = table.num_rows
            for a in range(0, n if everything else n - n % rows, rows):
                part = table.slice(a, rows)
                key = part["key"].to_numpy()
                vec = part["vec"].combine_chunks()
                sizes = pc.list_value_length(vec)
                flat = vec.null_count == 0 and pc.count_distinct(sizes).as_py() == 1 and (values := vec.flatten()).null_count == 0
                x = values.to_numpy().astype(dtype).reshape(len(vec), -1) if flat else matrix(vec.to_pylist(), dtype)
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((at, len(x), key.min(), key.max(), part["id"].to_numpy().astype("<i8").tobytes(), part["weight"].to_numpy().astype("<i8").tobytes(), x.tobytes()), schema)], schema=schema)
                at += 1
            held = table.slice(n - n % rows).to_batches() if n % rows and not everything else []

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= rows:
                yield from cut(False)
        if held:
            yield from cut(True)

    kind = {"<f4": "array<float>", "<f8": "array<double>", "<i8": "array<bigint>"}[dtype]
    laid = vectors.select(F.col("id").cast("long").alias("id"), F.col("weight").cast("long").alias("weight"), F.col("key").cast("double").alias("key"), F.col("vec").cast(kind).alias("vec"), *[F.col(c) for c in order if c not in ("id", "weight", "key", "vec")])
    laid = laid.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "weight", "key", "vec")
    return laid.mapInArrow(run, "tile long, n long, lo double, hi double, ids binary, weights binary, data binary")


def is_float(df: DataFrame, column: str) -> bool:
    kind = df.schema[column].dataType
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
