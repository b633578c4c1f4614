"""Structured Streaming: counts of events by the hour, and documents kept up to date as new versions arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamgraph.session import shared_path

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
DOCUMENTS = "document_id long, content string, modified timestamp"


def hourly(events: DataFrame, delay: str = "2 hours") -> DataFrame:
    """hour, level, events: of rows with ts and event_type, each event_id counted once within the delay, later ones dropped."""
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARNING").otherwise("INFO")
    timed = events.select("event_id", F.col("ts").cast("timestamp").alias("at"), level.alias("level")).withWatermark("at", delay)
    counts = timed.dropDuplicatesWithinWatermark(["event_id"]).groupBy(F.window("at", "1 hour").alias("w"), "level").agg(F.count("*").alias("events"))
    return counts.select(F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "level", "events")


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """What batches below ``path`` wrote, of each key what the last one did."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    last = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("batch")))
    return rows.withColumn("n", last).filter("n = 1").drop("n", "batch")


def run_to_end(counts: DataFrame, path: str) -> None:
    """Run a streamed aggregation over all there is. Each batch overwrites a folder of its own number, so a batch that runs twice leaves the same files."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    counts.writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def sync(arriving: DataFrame, path: str) -> None:
    """Keep documents (document_id, content, modified, content_hash, version) below ``path`` as versions arrive.

    Of a document the version modified last wins, whatever came last; a version with the stored
    hash is skipped, so it keeps its number. Each batch writes the whole state under its own
    number from that of the batch before; a batch that runs twice leaves the same state.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = read_state(spark, path, number - 1)
        hashed = batch.withColumn("content_hash", F.sha2(F.coalesce("content", F.lit("")), 256)).withColumn("new", F.lit(1))
        both = state.withColumn("new", F.lit(0)).unionByName(hashed.withColumn("version", F.lit(0)))
        by = W.partitionBy("document_id")
        order = by.orderBy(F.desc_nulls_last("modified"), "new", "content_hash")
        kept = both.withColumn("n", F.row_number().over(order)).withColumn("had", F.max("version").over(by)).withColumn("old", F.max(F.when(F.col("new") == 0, F.col("content_hash"))).over(by)).filter("n = 1")
        version = F.when(F.col("content_hash").eqNullSafe(F.col("old")), F.col("had")).otherwise(F.col("had") + 1)
        kept.select("document_id", "content", "modified", "content_hash", version.alias("version")).write.mode("overwrite").parquet(f"{path}/state={number}")

    arriving.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def read_state(spark: SparkSession, path: str, number: int) -> DataFrame:
    schema = "document_id long, content string, modified timestamp, content_hash string, version int"
    return spark.createDataFrame([], schema) if number < 0 else spark.read.schema(schema).parquet(f"{path}/state={number}")


def stream_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts by a stream over the whole table; the same as the batch form."""
    path = shared_path(spark, "event-counts")
    one = spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/event[s].parquet")  # a glob may name a file or a folder
    run_to_end(hourly(one, "3650 days"), path)
    return latest(spark, path, ["hour", "level"])


QUERIES = {"stream_event_counts": stream_event_counts}
ORACLE_SQL = {"stream_event_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END AS level, count(*) AS events FROM events GROUP BY 1, 2"}
