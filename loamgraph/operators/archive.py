"""The archive around the graph: ingestion states, drift, questions, conversations and monitoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamgraph.functions import salvage as J
from loamgraph.functions import text as T
from loamgraph.sources.bindings import source_documents, table

#: Stores that are kept beside the source, and what they lack at hand: ids that these divide. Each holds three ids that the source lost.
STORES = {"graph": 10, "embedding": 7, "hash": 11}
LOST = 3


def held_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a held tag are not indexed."""
    tags = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("document_id")).distinct().withColumn("held", F.lit(True))
    return source_documents(spark, sf_dir).select("document_id").join(tags, "document_id", "left").select("document_id", F.coalesce("held", F.lit(False)).alias("held"))


def unchanged(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """document_id and whether its content hash equals the stored one: skipped, else processed."""
    known = hashes.select("document_id", F.col("content_hash").alias("old"))
    return docs.join(known, "document_id", "left").select("document_id", F.when(F.col("content_hash").eqNullSafe(F.col("old")), "skipped").otherwise("processed").alias("status"))


def hash_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose content hash is stored already are skipped; some stored hashes are of older contents."""
    return unchanged(source_documents(spark, sf_dir).select("document_id", "content_hash"), stored_hashes(spark, sf_dir))


def stored_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the hash store holds: document_id, content_hash."""
    old = F.when(F.col("document_id") % 13 == 0, F.sha2(F.concat("content", F.lit("old")), 256)).otherwise(F.col("content_hash"))
    kept = source_documents(spark, sf_dir).select("document_id", old.alias("content_hash"))
    return store_ids(spark, sf_dir, "hash").join(kept, "document_id", "left")


def store_ids(spark: SparkSession, sf_dir: str, store: str) -> DataFrame:
    """Ids that a store holds."""
    docs = source_documents(spark, sf_dir).select("document_id")
    lost = docs.agg(F.max("document_id").alias("m")).select(F.explode(F.sequence(F.col("m") + 1, F.col("m") + LOST)).alias("document_id"))
    return docs.filter(F.col("document_id") % STORES[store] != 0).unionByName(lost)


def drift(source: DataFrame, stores: dict[str, DataFrame]) -> DataFrame:
    """(document_id, store, kind) of ids that a store lacks (missing) or the source does (extra)."""
    source = source.select("document_id").distinct()
    out = None
    for name, ids in stores.items():
        ids = ids.select("document_id").distinct()
        for kind, one in (("missing", source.join(ids, "document_id", "left_anti")), ("extra", ids.join(source, "document_id", "left_anti"))):
            one = one.select("document_id", F.lit(name).alias("store"), F.lit(kind).alias("kind"))
            out = one if out is None else out.unionByName(one)
    return out


def repair_targets(drifted: DataFrame) -> DataFrame:
    """(document_id, action): what any store lacks is indexed again; what only stores hold is deleted."""
    return drifted.groupBy("document_id").agg(F.when(F.bool_or(F.col("kind") == "missing"), "reindex").otherwise("delete").alias("action"))


def _drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift(source_documents(spark, sf_dir), {k: store_ids(spark, sf_dir, k) for k in STORES})


def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each store, how many ids it lacks and how many the source lost."""
    return _drift(spark, sf_dir).groupBy("store").agg(F.count_if(F.col("kind") == "missing").alias("missing"), F.count_if(F.col("kind") == "extra").alias("extra"))


def drift_repair_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_targets(_drift(spark, sf_dir))


def deleted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the graph that the source lost."""
    return store_ids(spark, sf_dir, "graph").join(source_documents(spark, sf_dir), "document_id", "left_anti")


def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: how many documents the source and each store hold, the latest of the source, and whether anything drifted."""
    docs = source_documents(spark, sf_dir).agg(F.count("*").alias("source_documents"), F.max("document_id").alias("latest_id"))
    for k in STORES:
        docs = docs.crossJoin(store_ids(spark, sf_dir, k).agg(F.count("*").alias(f"{k}_documents")))  # rows of one
    return docs.crossJoin(_drift(spark, sf_dir).agg((F.count("*") > 0).alias("stale")))


def upserted(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows of both, of each key the one with the largest ``order``; of equal ones any of the new."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    last = F.row_number().over(W.partitionBy(*key).orderBy(F.desc(order), F.desc("__new")))
    return both.withColumn("__n", last).filter("__n = 1").drop("__n", "__new")


def upsert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document rows after a run over every third document: those are of the second version, the others of the first."""
    docs = source_documents(spark, sf_dir).select("document_id", "content_hash")
    return upserted(docs.withColumn("version", F.lit(1)), docs.filter("document_id % 3 = 0").withColumn("version", F.lit(2)), ["document_id"], "version")


def classify_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "benchmark").select("item_id", T.intent(q).alias("intent"), F.size(T.query_terms(q)).cast("long").alias("n_terms"))


def conversation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, those without a message of the user or assistant too, the one with the latest message first."""
    messages = table(spark, sf_dir, "conversations")
    spoken = messages.filter("role <> 'system'").groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"))
    out = messages.select("conv_id").distinct().join(spoken, "conv_id", "left").select("conv_id", F.coalesce("messages", F.lit(0)).alias("messages"), "last_turn")
    return out.withColumn("position", F.row_number().over(W.orderBy(F.desc_nulls_last("last_turn"), "conv_id")))


def _numbered(spark: SparkSession, sf_dir: str, *order) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumn("n", F.row_number().over(W.partitionBy("conv_id").orderBy(*order)))


def conversation_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last six messages of each conversation, numbered in the order they were written."""
    last = _numbered(spark, sf_dir, F.desc("turn")).filter("n <= 6")
    return last.select("conv_id", "turn", "role", "text", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).alias("position"))


def conversation_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last six messages of each conversation as one text, 600 characters of each."""
    line = F.concat(F.initcap("role"), F.lit(": "), F.substring(F.coalesce("text", F.lit("")), 1, 600))
    last = _numbered(spark, sf_dir, F.desc("turn")).filter("n <= 6").select("conv_id", F.struct("turn", line.alias("line")).alias("m"))
    return last.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["line"]), "\n").alias("context"))


def conversation_first_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first message of the user, cut to 80 characters, titles a conversation."""
    user = table(spark, sf_dir, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return user.select("conv_id", F.when(F.length("text") > 80, F.concat(F.substring("text", 1, 80), F.lit("..."))).otherwise(F.col("text")).alias("title"))


def chunks_first_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three rows of each group, with the constant similarity of that read."""
    return _numbered(spark, sf_dir, "turn").filter("n <= 3").select("conv_id", "turn", F.lit(0.4).alias("similarity"))


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARNING").otherwise("INFO")
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", level.alias("level"), F.col("props").alias("message"))


def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logs(spark, sf_dir).orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select("event_id", "level", "message")


def run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _logs(spark, sf_dir)
    return one.groupBy("user_id").agg(F.count_if(F.col("level") == "INFO").alias("processed"), F.count_if(F.col("level") == "WARNING").alias("skipped"), F.count_if(F.col("level") == "ERROR").alias("errors"))


def guardrail_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with more than a quarter of errors."""
    total = F.col("processed") + F.col("skipped") + F.col("errors")
    return run_progress(spark, sf_dir).filter(F.col("errors") * 4 > total).select("user_id", "errors", total.alias("total"))


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each level by hour; the batch form of the streamed counts."""
    return _logs(spark, sf_dir).groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH").alias("hour"), "level").agg(F.count("*").alias("events"))


def log_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at least WARNING behind the median event, the latest hundred in order."""
    rank = F.when(F.col("level") == "ERROR", 2).when(F.col("level") == "WARNING", 1).otherwise(0)
    lines = _logs(spark, sf_dir)
    middle = lines.agg((F.max("event_id") / 2).alias("middle"))
    kept = lines.crossJoin(middle).filter((rank >= 1) & (F.col("event_id") > F.col("middle")))  # one row
    return kept.orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "level", "message")


def salvaged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of clicks with what could be read of those that are broken, and how."""
    rows = table(spark, sf_dir, "clicks").select("click_id", J.salvaged(F.col("props")).alias("s"))
    return rows.select("click_id", "s.how", F.get_json_object("s.json", "$.k").alias("k"), F.get_json_object("s.json", "$.device.os").alias("os"))


QUERIES = {
    f.__name__: f
    for f in (
        held_partition, hash_skip, drift_report, drift_repair_targets, deleted_documents, freshness, upsert_documents, classify_question, conversation_list, conversation_history,
        conversation_context, conversation_first_title, chunks_first_k, log_tail, log_filter, run_progress, guardrail_alerts, event_counts, salvaged_records,
    )
}
_LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END"
_RUN = f"SELECT user_id, count_if({_LEVEL} = 'INFO') AS processed, count_if({_LEVEL} = 'WARNING') AS skipped, count_if({_LEVEL} = 'ERROR') AS errors FROM events GROUP BY 1"
_INTENT = "CASE " + " ".join(f"WHEN {T.sql_any('text', terms)} THEN '{name}'" for name, terms in [("timeline", T.TIMELINE), ("current_state", T.CURRENT), ("compare", T.COMPARE), ("broad_inventory", T.INVENTORY)]) + " ELSE 'lookup' END"
_IDS = "WITH src AS (SELECT doc_id FROM documents), stores AS (" + " UNION ALL ".join(f"SELECT '{k}' AS store, doc_id FROM documents WHERE doc_id % {n} <> 0 UNION ALL SELECT '{k}', (SELECT max(doc_id) FROM documents) + unnest([1, 2, 3])" for k, n in STORES.items()) + ")"
_DRIFT = _IDS + ", drift AS (" + " UNION ALL ".join(f"SELECT '{k}' AS store, 'missing' AS kind, doc_id FROM (SELECT doc_id FROM src EXCEPT SELECT doc_id FROM stores WHERE store = '{k}') UNION ALL SELECT '{k}', 'extra', doc_id FROM (SELECT doc_id FROM stores WHERE store = '{k}' EXCEPT SELECT doc_id FROM src)" for k in STORES) + ")"
ORACLE_SQL = {
    "salvaged_records": "SELECT click_id, how, json_extract_string(j, '$.k') AS k, json_extract_string(j, '$.device.os') AS os FROM (SELECT click_id, CASE WHEN props IS NULL OR trim(props) = '' THEN 'empty' WHEN json_valid(props) THEN 'whole' WHEN json_valid(props || '}') THEN 'closed' ELSE 'lost' END AS how, CASE WHEN json_valid(props) THEN props WHEN json_valid(props || '}') THEN props || '}' END AS j FROM clicks)",
    "held_partition": "SELECT doc_id AS document_id, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS held FROM documents",
    "hash_skip": "SELECT doc_id AS document_id, CASE WHEN doc_id % 11 <> 0 AND doc_id % 13 <> 0 THEN 'skipped' ELSE 'processed' END AS status FROM documents",
    "drift_report": _DRIFT + " SELECT store, count_if(kind = 'missing') AS missing, count_if(kind = 'extra') AS extra FROM drift GROUP BY 1",
    "drift_repair_targets": _DRIFT + " SELECT doc_id AS document_id, CASE WHEN doc_id IN (SELECT doc_id FROM src) THEN 'reindex' ELSE 'delete' END AS action FROM drift GROUP BY 1, 2",
    "deleted_documents": _IDS + " SELECT doc_id AS document_id FROM stores WHERE store = 'graph' AND doc_id NOT IN (SELECT doc_id FROM src)",
    "freshness": _DRIFT + " SELECT (SELECT count(*) FROM src) AS source_documents, (SELECT max(doc_id) FROM src) AS latest_id, " + ", ".join(f"(SELECT count(*) FROM stores WHERE store = '{k}') AS {k}_documents" for k in STORES) + ", (SELECT count(*) > 0 FROM drift) AS stale",
    "upsert_documents": "SELECT doc_id AS document_id, sha256(coalesce(text, '')) AS content_hash, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM documents",
    "classify_question": f"SELECT item_id, {_INTENT} AS intent, len({T.sql_query_terms('text')}) AS n_terms FROM benchmark",
    "conversation_list": "SELECT conv_id, count(*) FILTER (role <> 'system') AS messages, max(turn) FILTER (role <> 'system') AS last_turn, row_number() OVER (ORDER BY last_turn DESC NULLS LAST, conv_id) AS position FROM conversations GROUP BY 1",
    "conversation_history": "SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM (SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6)",
    "conversation_context": "SELECT conv_id, string_agg(upper(role[1]) || role[2:] || ': ' || substr(coalesce(text, ''), 1, 600), chr(10) ORDER BY turn) AS context FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6) GROUP BY 1",
    "log_filter": f"SELECT event_id, {_LEVEL} AS level, props AS message FROM events WHERE {_LEVEL} <> 'INFO' AND event_id > (SELECT max(event_id) / 2 FROM events) ORDER BY ts DESC, event_id DESC LIMIT 100",
    "conversation_first_title": "SELECT conv_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS title FROM (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY 1)",
    "chunks_first_k": "SELECT conv_id, turn, 0.4::DOUBLE AS similarity FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3",
    "log_tail": f"SELECT event_id, {_LEVEL} AS level, props AS message FROM events ORDER BY ts DESC, event_id DESC LIMIT 500",
    "run_progress": _RUN,
    "guardrail_alerts": f"SELECT user_id, errors, processed + skipped + errors AS total FROM ({_RUN}) WHERE errors * 4 > processed + skipped + errors",
    "event_counts": f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, {_LEVEL} AS level, count(*) AS events FROM events GROUP BY 1, 2",
}
