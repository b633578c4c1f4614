"""Plans of questions: mode, domain, intent, sub-questions, entity types and concepts. One row for each question of a table, so that many questions are one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.functions import questions as Q
from loamgraph.functions import text as T
from loamgraph.sources.bindings import table

#: Modes that the questions at hand are asked in, by their id.
MODES = ["quick", "deep", "timeline", "strict", "fast", "high_stakes", "other"]
#: The questions at hand are invented prose; these matters, by their id, give the rules something to find.
MATTERS = [
    "what is my insurance policy premium and deductible", "tax return and w-2 of the bank account", "history of the mortgage loan payments", "compare all medical lab results, doctor visits and blood tests",
    "who is the vendor of the truck", "where is the house", "every lease agreement", "deployment orders", "plain words", "complete list of levels, amounts and balances", "all notices",
]


def planned(questions: DataFrame) -> DataFrame:
    """item_id, text, mode of a table of questions with the plan's columns."""
    q = F.col("text")
    out = questions.withColumn("mode", Q.normalize_mode(F.col("mode"))).withColumn("domain", Q.domain(q)).withColumn("intent", Q.intent(q, F.col("mode")))
    return out.withColumn("requires_current", Q.requires_current(q, F.col("domain"), F.col("intent"))).withColumn("needs_timeline", F.col("intent") == "timeline").withColumn("doc_types", F.array_join(Q.required_doc_types(F.col("domain")), ","))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.element_at(F.array(*map(F.lit, MODES)), (F.col("item_id") % len(MODES) + 1).cast("int"))
    matter = F.element_at(F.array(*map(F.lit, MATTERS)), (F.col("item_id") % len(MATTERS) + 1).cast("int"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), matter).alias("text"), mode.alias("mode"))


def question_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned(_questions(spark, sf_dir)).drop("text")


def plan_subqueries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sub-questions that are asked, in order from 1."""
    asked = _questions(spark, sf_dir).withColumn("mode", Q.normalize_mode(F.col("mode")))
    out = Q.with_retrieval_queries(asked).select("item_id", F.posexplode("asked").alias("p", "s"))
    return out.select("item_id", (F.col("p") + 1).cast("long").alias("position"), "s.role", "s.query")


def broad_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("text")
    return _questions(spark, sf_dir).select("item_id", Q.broad(q).alias("broad"), Q.requires_latest(q).alias("latest_check"), Q.high_stakes(q, Q.domain(q)).alias("high_stakes"))


def latest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions on matters that change get a second one for the latest state."""
    return _questions(spark, sf_dir).filter(Q.requires_latest(F.col("text"))).select("item_id", F.concat("text", F.lit(T.LATEST_SUFFIX)).alias("query"))


def relevant_entity_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("item_id", F.array_join(Q.entity_types(F.col("text")), ",").alias("types"))


def concept_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("item_id", F.array_join(Q.concept_terms(F.col("text")), " ").alias("terms"))


QUERIES = {f.__name__: f for f in (question_plan, plan_subqueries, broad_question, latest_check, relevant_entity_types, concept_expansion)}

_list = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"
_MODE = "CASE item_id % 7 WHEN 0 THEN 'quick' WHEN 2 THEN 'timeline' WHEN 3 THEN 'strict' WHEN 4 THEN 'quick' WHEN 5 THEN 'strict' ELSE 'deep' END"
_INTENT = "CASE WHEN mode = 'timeline' THEN 'timeline' " + " ".join(f"WHEN {T.sql_any('text', terms)} THEN '{name}'" for name, terms in [("timeline", T.TIMELINE), ("current_state", T.CURRENT), ("compare", T.COMPARE), ("broad_inventory", T.INVENTORY)]) + " ELSE 'lookup' END"
_Q = f"WITH q AS (SELECT item_id, coalesce(text, '') || ' ' || ({_list(MATTERS)})[item_id % {len(MATTERS)} + 1] AS text, {_MODE} AS mode FROM benchmark)"
_PLAN = f"""{_Q},
d AS (SELECT *, {Q.sql_domain('text')} AS domain, {_INTENT} AS intent FROM q),
plan AS (SELECT *, intent IN ('current_state', 'timeline') OR {T.sql_any('text', T.CURRENT)} OR list_contains({_list(Q.CURRENT_DOMAINS)}, domain) AS requires_current FROM d)
"""
_TYPES = "CASE domain " + " ".join(f"WHEN '{d}' THEN '{','.join(t)}'" for d, t in Q.DOC_TYPES.items()) + " ELSE '' END"
_SUB = f"""[{{'role': 'primary', 'query': text}},
CASE WHEN mode <> 'quick' AND requires_current THEN {{'role': 'current_state', 'query': text || ' {Q.LATEST}'}} END,
CASE WHEN mode <> 'quick' AND domain <> 'general' THEN {{'role': 'domain_inventory', 'query': domain || ' {Q.INVENTORY} ' || text}} END,
CASE WHEN mode <> 'quick' AND intent = 'timeline' THEN {{'role': 'timeline_dates', 'query': text || ' {Q.TIMELINE_DATES}'}} END,
CASE WHEN mode = 'strict' THEN {{'role': 'source_quality', 'query': text || ' {Q.SOURCE_QUALITY}'}} END,
CASE WHEN mode = 'strict' THEN {{'role': 'contradiction_check', 'query': text || ' {Q.CONTRADICTION}'}} END]"""
_FOUND = "list_distinct(flatten([" + ", ".join(f"CASE WHEN {T.sql_any('text', words)} THEN {_list(types)} ELSE []::VARCHAR[] END" for words, types in Q.SIGNALS) + "]))"


def _concepts() -> str:
    sql = _Q + ", t AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9$]+'), lambda x: length(x) >= 3)) AS t FROM q), "
    sql += "e0 AS (SELECT item_id, list_distinct(list_concat(t, list_transform(t, lambda x: CASE WHEN ends_with(x, 's') AND length(x) > 3 THEN substr(x, 1, length(x) - 1) ELSE x || 's' END))) AS e FROM t)"
    for i, group in enumerate(Q.CONCEPTS):
        sql += f", e{i + 1} AS (SELECT item_id, CASE WHEN list_has_any(e, {_list(group)}) THEN list_distinct(list_concat(e, {_list(group)})) ELSE e END AS e FROM e{i})"
    return sql + f" SELECT item_id, array_to_string(list_sort(e), ' ') AS terms FROM e{len(Q.CONCEPTS)}"


ORACLE_SQL = {
    "question_plan": _PLAN + f"SELECT item_id, mode, domain, intent, requires_current, intent = 'timeline' AS needs_timeline, {_TYPES} AS doc_types FROM plan",
    "plan_subqueries": _PLAN + f"SELECT item_id, unnest(range(1, len(s) + 1)) AS position, unnest(s).role AS role, trim(unnest(s).query) AS query FROM (SELECT item_id, list_filter({_SUB}, lambda x: x IS NOT NULL)[1:CASE mode WHEN 'quick' THEN 1 WHEN 'strict' THEN 8 ELSE 6 END] AS s FROM plan)",
    "broad_question": _PLAN + f"SELECT item_id, {Q.sql_hits('text', Q.BROAD)} >= 1 AND ({T.sql_any('text', Q.SEVERAL)} OR {Q.sql_hits('text', Q.BROAD)} >= 2) AS broad, {T.sql_any('text', Q.SENSITIVE)} AS latest_check, list_contains({_list(Q.HIGH_STAKES_DOMAINS)}, domain) OR {T.sql_any('text', Q.HIGH_STAKES)} AS high_stakes FROM plan",
    "latest_check": _Q + f" SELECT item_id, text || '{T.LATEST_SUFFIX}' AS query FROM q WHERE {T.sql_any('text', Q.SENSITIVE)}",
    "relevant_entity_types": _Q + f" SELECT item_id, array_to_string(list_sort(CASE WHEN {T.sql_any('text', Q.BROAD_WORDS)} AND len(f) < 3 THEN list_distinct(list_concat(f, {_list(Q.BROAD_TYPES)})) ELSE f END), ',') AS types FROM (SELECT item_id, text, {_FOUND} AS f FROM q)",
    "concept_expansion": _concepts(),
}
