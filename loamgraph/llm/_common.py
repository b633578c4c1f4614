"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Hashable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.session import reachable


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text) of any table of documents; a null text counts as empty, other columns are dropped."""
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/loamgraph-checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/loamgraph/{uuid.uuid4().hex}"


def stored(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again, so that lost executors cost one task, not the job."""
    path = shared_dir(df.sparkSession)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete the files of stored() frames after their last reader has been written itself."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Bits:
    """Bits that travel compressed, as most of a filter is often empty."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __reduce__(self):
        return _unpacked, (pa.compress(self.bits, codec="zstd", asbytes=True), len(self.bits))


def _unpacked(data: bytes, size: int) -> Bits:
    return Bits(np.frombuffer(pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True), np.uint8))


def filter_bits(keys: DataFrame, size: int) -> Bits:
    """A filter of ``size`` bits, whatever the number of rows, over a column ``h`` of longs from 0 to size - 1."""
    parts = keys.groupBy((F.col("h") / 32768).cast("int").alias("k")).agg(F.bitmap_construct_agg(F.col("h") % 32768).alias("bits")).collect()
    bits = np.zeros(size // 8, np.uint8)
    for r in parts:
        bits[r.k * 4096 : (r.k + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    return Bits(bits)


def in_filter(bits: Bits, h: np.ndarray) -> np.ndarray:
    return (bits.bits[h >> 3] >> (h & 7).astype(np.uint8)) & 1 > 0


def modest_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of whole texts stay small, as some texts are very long."""
    reachable(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def crc32_mod(column: str, n: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


_RESIDENT: dict[Hashable, Any] = {}


def resident(key: Hashable, build: Callable[[], Any]) -> Any:
    """A large object of a Python worker, kept from task to task; the one before it goes before it is built, as workers serve many operators."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        gc.collect()
        _RESIDENT[key] = build()
    return _RESIDENT[key]


def release() -> None:
    """Let go of what resident() keeps; operators without such an object call it first."""
    _RESIDENT.clear()
