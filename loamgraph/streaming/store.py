"""Stores kept in step with a source: rows by document in buckets, of which a batch rewrites only those it touches.

A batch writes the buckets of its documents anew, under its own number, and then a manifest of
which number holds each bucket. Readers go by the last complete manifest, so they see a batch
whole or not at all; a batch that runs again starts from the manifest before it and leaves the
same rows. Old files can go once no reader needs their manifest (vacuum).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.operators.retrieval import passages
from loamgraph.session import settled, shared_path
from loamgraph.sources.bindings import source_documents


class Store:
    """Rows with a document_id and the given schema below ``path``, in so many buckets: choose as many as a batch's documents are few, each of a size that one task may rewrite."""

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.buckets = spark, path, schema, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("document_id"), F.lit(self.buckets)).cast("int")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def batches(self) -> list[int]:
        """Numbers of the complete batches, in order."""
        fs, p = self._fs(f"{self.path}/manifest")
        if not fs.exists(p):
            return []
        names = [s.getPath() for s in fs.listStatus(p)]
        return sorted(int(x.getName().split("=")[1]) for x in names if x.getName().startswith("batch=") and self._done(x.toString()))

    def _done(self, path: str) -> bool:
        fs, p = self._fs(f"{path}/_SUCCESS")
        return fs.exists(p)

    def manifest(self, before: int | None = None) -> dict[int, int]:
        """The batch that holds each bucket, by the last complete manifest (before a batch): at most ``buckets`` rows."""
        known = [b for b in self.batches() if before is None or b < before]
        return {r.bucket: r.number for r in self.spark.read.schema("bucket int, number int").parquet(f"{self.path}/manifest/batch={known[-1]}").collect()} if known else {}

    def read(self, buckets: list[int] | None = None, before: int | None = None) -> DataFrame:
        """All rows, or those of some buckets, as the last batch (before another) left them; only the files of these buckets are opened."""
        held = self.manifest(before)
        paths = [f"{self.path}/rows/batch={n}/bucket={b}" for b, n in sorted(held.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def replace(self, number: int, rows: DataFrame, ids: DataFrame) -> int:
        """Batch ``number``: all rows of the documents ``ids`` go, ``rows`` come. Gives the number of buckets written."""
        ids = ids.select("document_id").distinct()
        touched = sorted(r[0] for r in ids.select(self._bucket()).distinct().collect())
        held = self.manifest(number)
        kept = self.read(touched, number).join(ids, "document_id", "left_anti")
        columns = self.read([], number).columns
        out = kept.select(*columns).unionByName(rows.select(*columns)).withColumn("bucket", self._bucket())
        if touched:
            out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/batch={number}")
        fs, _ = self._fs(self.path)
        here = {b: number for b in touched if fs.exists(self._fs(f"{self.path}/rows/batch={number}/bucket={b}")[1])}
        new = {b: n for b, n in held.items() if b not in touched} | here
        self.spark.createDataFrame(sorted(new.items()), "bucket int, number int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={number}")
        return len(touched)

    def vacuum(self) -> None:
        """Delete files that the last manifest doesn't need; a batch before it cannot run again then."""
        held = self.manifest()
        last = self.batches()[-1:]
        for b in self.batches():
            for sub in [f"rows/batch={b}/bucket={k}" for k in range(self.buckets) if held.get(k) != b] + ([] if [b] == last else [f"manifest/batch={b}"]):
                fs, p = self._fs(f"{self.path}/{sub}")
                fs.delete(p, True)


DOCUMENTS = "document_id long, title string, doc_type string, content string, content_hash string, version int"
CHUNKS = "document_id long, chunk_index int, content string"


class Archive:
    """A store of documents and one of their chunks, kept in step."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.documents = Store(spark, f"{path}/documents", DOCUMENTS, buckets)
        self.chunks = Store(spark, f"{path}/chunks", CHUNKS, buckets)

    def sync(self, number: int, arriving: DataFrame, deleted: DataFrame | None = None) -> tuple[int, int]:
        """Take over a batch of documents (document_id, title, doc_type, content) and deletions (document_id); a document in both is deleted.

        A document whose hash is stored is skipped and keeps its version and chunks; null contents
        are empty, rows without an id are left out, and of several rows of an id the one with the
        largest hash counts. Gives the buckets written in either store.
        """
        hashed = arriving.filter("document_id IS NOT NULL").withColumn("content", F.coalesce("content", F.lit(""))).withColumn("content_hash", F.sha2("content", 256))
        one = hashed.groupBy("document_id").agg(F.max(F.struct("content_hash", "title", "doc_type", "content")).alias("d")).select("document_id", "d.*")
        if deleted is not None:
            one = one.join(deleted.select("document_id"), "document_id", "left_anti")
        buckets = sorted(r[0] for r in one.select(self.documents._bucket()).distinct().collect())
        old = self.documents.read(buckets, number).select("document_id", F.col("content_hash").alias("old"), F.col("version").alias("had"))
        changed = one.join(old, "document_id", "left").filter("old IS NULL OR old <> content_hash").withColumn("version", (F.coalesce("had", F.lit(0)) + 1).cast("int")).drop("old", "had")
        changed = settled(changed)  # read below for rows and ids of either store
        ids = changed.select("document_id") if deleted is None else changed.select("document_id").unionByName(deleted.select(F.col("document_id").cast("long")))
        cut = passages(changed.withColumn("date", F.lit(None).cast("string")))
        # Chunks come first: both stores read the documents as they were before this batch.
        return self.chunks.replace(number, cut, ids), self.documents.replace(number, changed, ids)


def incremental_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive after three batches: all documents; every tenth changed, with some that did not; every twenty-fifth deleted. Document, version, hash and chunks."""
    archive = Archive(spark, shared_path(spark, "archive"))
    docs = source_documents(spark, sf_dir).select("document_id", "title", "doc_type", "content")
    archive.sync(0, docs)
    tenth = F.col("document_id") % 10 == 0
    archive.sync(1, docs.filter(F.col("document_id") % 5 == 0).withColumn("content", F.when(tenth, F.concat("content", F.lit(" revised"))).otherwise(F.col("content"))))
    archive.sync(2, docs.limit(0), docs.filter(F.col("document_id") % 25 == 1).select("document_id"))
    counts = archive.chunks.read().groupBy("document_id").agg(F.count("*").alias("chunks"))
    return archive.documents.read().join(counts, "document_id").select("document_id", "version", "content_hash", "chunks")


QUERIES = {"incremental_sync": incremental_sync}
ORACLE_SQL = {
    "incremental_sync": "SELECT document_id, version, sha256(content) AS content_hash, greatest(1, ceil((length(content) - 200) / 1000.0))::BIGINT AS chunks FROM (SELECT doc_id AS document_id, CASE WHEN doc_id % 10 = 0 THEN 2 ELSE 1 END::INT AS version, coalesce(text, '') || CASE WHEN doc_id % 10 = 0 THEN ' revised' ELSE '' END AS content FROM documents WHERE doc_id % 25 <> 1)",
}
