"""Rules over names and dates, applied to the names and dates at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.functions import dates as D
from loamgraph.functions import names as N
from loamgraph.sources.bindings import nodes, table

# Forms that the names at hand are written in, by their number, so that every rule has cases.
FORMS = ["{n}", "Dr. {n}", "{n} Inc", "LLC {n}", "Smith, {n}", "{n} 27601-1234 Main", "12 {n} St", "N/A", "processing {n}", "{n}'s"]


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label and a written form of all nodes but documents."""
    k = F.pmod(F.regexp_extract("id", "[0-9]+", 0).cast("long"), F.lit(len(FORMS)))
    form = F.element_at(F.array(*map(F.lit, FORMS)), (k + 1).cast("int"))
    return nodes(spark, sf_dir).filter("label <> 'Document'").select("id", "label", F.replace(form, F.lit("{n}"), F.col("name")).alias("name"))


def name_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("name")
    return _named(spark, sf_dir).select("id", N.name(n).alias("plain"), N.person_name(n).alias("person"), N.org_name(n).alias("organization"), N.steward_name(n).alias("steward"), N.identifier(n).alias("identifier"))


def valid_entity_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("id", "name", N.valid_entity_name(F.col("name")).alias("valid"), N.full_address(F.col("name")).alias("address"))


def distinctive_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("id", F.array_join(N.distinctive(F.col("name")), " ").alias("words"))


def rel_type_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationship and entity types as they are written, brought into one form."""
    t = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name")
    return t.select("p_partkey", N.relation_type(F.concat("p_type", F.lit(" - "), "p_name")).alias("rel_type"), N.entity_type(F.col("p_type")).alias("entity_type"))


def canonical_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The better of each part's name and of another form of it."""
    other = F.expr("CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN concat(p_name, ' jr') WHEN 2 THEN concat(p_name, ' 9') ELSE initcap(p_name) END")
    return table(spark, sf_dir, "part").select("p_partkey", N.canonical(F.col("p_name"), other).alias("name"))


# Each order's date in one of six forms.
_DATES = "CASE o_orderkey % 6 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'M/d/yyyy') WHEN 2 THEN date_format(o_orderdate, 'MMMM d, yyyy') WHEN 3 THEN date_format(o_orderdate, 'yyyy') WHEN 4 THEN concat('Date of Issue: ', date_format(o_orderdate, 'yyyy-MM-dd')) ELSE 'no date' END"


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.expr(_DATES).alias("date"))


def date_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("date")
    return _dated(spark, sf_dir).select("o_orderkey", D.date_key(x).alias("date_key"), D.summary_date(F.regexp_replace(x, "199", "201")).alias("summary_date"), N.date_string(x).alias("is_date"))


def timeline_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty events of each priority by date, then title."""
    from pyspark.sql import Window as W

    events = _dated(spark, sf_dir).filter("date <> 'no date'").select("o_orderpriority", D.date_key(F.col("date")).alias("date_key"), F.concat(F.lit("Order "), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("title"))
    return events.withColumn("position", F.row_number().over(W.partitionBy("o_orderpriority").orderBy("date_key", "title"))).filter("position <= 20")


QUERIES = {f.__name__: f for f in (name_normalize, valid_entity_name, distinctive_words, rel_type_sanitize, canonical_name, date_keys, timeline_sort)}

from loamgraph.sources.bindings import SQL  # noqa: E402 - the text that the SQL below begins with

_q = lambda s: s.replace("'", "''")
_list = lambda values: "[" + ", ".join(f"'{_q(v)}'" for v in values) + "]"
_NAMED = SQL + ", named AS (SELECT id, label, replace(" + _list(FORMS) + "[regexp_extract(id, '[0-9]+')::BIGINT % 10 + 1], '{n}', name) AS name FROM nodes WHERE label <> 'Document')"
_PLAIN = r"trim(regexp_replace(regexp_replace(CASE WHEN len(string_split(name, ',')) = 2 THEN trim(string_split(name, ',')[2]) || ' ' || trim(string_split(name, ',')[1]) ELSE name END, '[™®©.\-'']', ' ', 'g'), '\s+', ' ', 'g'))"
_TITLE = "|".join(t.replace(".", "[.]") for t in N.TITLES)
_WORDS = r"list_filter(string_split_regex(trim(name), '\s+'), lambda w: w <> '')"
_LOW = lambda x: f"(lower({x}) = {x} AND upper({x}) <> {x})"
_VALID = (
    f"NOT (length(trim(name)) < 3 OR list_contains({_list(N.BLOCKED)}, lower(trim(name))) OR regexp_matches(trim(name), '^[\\d,.$]+$') OR (len({_WORDS}) = 1 AND ({_LOW('trim(name)')} OR list_contains({_list(N.SMALL_WORDS)}, lower(trim(name)))))"
    + "".join(f" OR contains(lower(name), '{p}')" for p in N.ROLE_PHRASES)
    + f" OR (len({_WORDS}) >= 3 AND len(list_filter({_WORDS}, lambda w: NOT {_LOW('w')})) = 0) OR list_contains({_list(N.GERUNDS)}, lower({_WORDS}[1])) OR (upper(trim(name)) = trim(name) AND lower(trim(name)) <> trim(name) AND len({_WORDS}) <= 2 AND length(trim(name)) > 10 AND NOT list_contains({_list(N.ACRONYMS)}, trim(name))))"
)
_ADDRESS = "(" + " OR ".join([f"regexp_matches(name, '{p}')" for p in N.ADDRESSES] + [f"(regexp_matches(name, '{p}') AND length(name) > {n})" for p, n in N.LONG_ADDRESSES]) + ")"
_DATED = "WITH dated AS (SELECT o_orderkey, o_orderpriority, o_orderdate AS d, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%-m/%-d/%Y') WHEN 2 THEN strftime(o_orderdate, '%B %-d, %Y') WHEN 3 THEN strftime(o_orderdate, '%Y') WHEN 4 THEN 'Date of Issue: ' || strftime(o_orderdate, '%Y-%m-%d') ELSE 'no date' END AS date FROM orders)"
_KEY = "CASE o_orderkey % 6 WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%Y-%m-%d') WHEN 4 THEN strftime(d, '%Y-%m-%d') WHEN 5 THEN '9999' ELSE strftime(d, '%Y') END"
_NAME2 = "CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || ' jr' WHEN 2 THEN p_name || ' 9' ELSE array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') END"
_RANK = lambda x: f"[len(string_split({x}, ' ')), CASE WHEN {x} = upper({x}) THEN 1 WHEN {x} = lower({x}) THEN 0 ELSE 2 END, CASE WHEN regexp_matches({x}, '[0-9#@&%]') THEN 0 ELSE 1 END, CASE WHEN len(string_split({x}, ' ')) >= 3 THEN 1 ELSE 0 END, length({x})]"
ORACLE_SQL = {
    "name_normalize": _NAMED
    + f", p AS (SELECT id, name, {_PLAIN} AS plain FROM named) SELECT id, plain, regexp_replace(CASE WHEN regexp_matches(plain, '^(?i:(?:{_TITLE})[.]* )+.') THEN regexp_replace(plain, '^(?i:(?:{_TITLE})[.]* )+', '') ELSE plain END, '^(?i:and) ', '') AS person, "
    + f"CASE WHEN len(string_split(plain, ' ')) > 1 AND list_contains({_list(N.LEADING_SUFFIXES)}, lower(regexp_replace(string_split(plain, ' ')[1], ',+$', ''))) THEN array_to_string(string_split(plain, ' ')[2:], ' ') || ' ' || regexp_replace(string_split(plain, ' ')[1], ',+$', '') ELSE plain END AS organization, "
    + rf"trim(regexp_replace(regexp_replace(lower(name), '{N.STEWARD_SUFFIXES}', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS steward, lower(regexp_replace(name, '[^a-zA-Z0-9@.-]+', '', 'g')) AS identifier FROM p",
    "valid_entity_name": _NAMED + f" SELECT id, name, {_VALID} AS valid, {_ADDRESS} AS address FROM named",
    "distinctive_words": _NAMED + f" SELECT id, array_to_string(list_sort(list_distinct(list_filter(string_split(lower({_PLAIN}), ' '), lambda w: length(w) > 1 AND NOT list_contains({_list(N.ORG_SUFFIXES)}, w)))), ' ') AS words FROM named",
    "rel_type_sanitize": "SELECT p_partkey, trim(regexp_replace(upper(p_type || ' - ' || p_name), '[^A-Z0-9]+', '_', 'g'), '_') AS rel_type, array_to_string(list_transform(regexp_extract_all(lower(p_type), '[a-z]+|[^a-z]+'), lambda w: upper(w[1]) || w[2:]), '') AS entity_type FROM part",
    "canonical_name": f"SELECT p_partkey, CASE WHEN {_RANK('p_name')} >= {_RANK('o')} THEN p_name ELSE o END AS name FROM (SELECT *, {_NAME2} AS o FROM part)",
    "date_keys": _DATED + f" SELECT o_orderkey, {_KEY} AS date_key, CASE WHEN o_orderkey % 6 IN (0, 1, 2, 4) THEN replace(strftime(d, '%Y'), '199', '201') || strftime(d, '-%m-%d') END AS summary_date, o_orderkey % 6 <> 5 AS is_date FROM dated",
    "timeline_sort": _DATED + f" SELECT o_orderpriority, {_KEY} AS date_key, 'Order ' || lpad(o_orderkey::VARCHAR, 9, '0') AS title, row_number() OVER (PARTITION BY o_orderpriority ORDER BY date_key, title) AS position FROM dated WHERE date <> 'no date' QUALIFY position <= 20",
}
