"""From what was extracted of documents to nodes and edges: rules by document type, applied to each record in one pass.

A record is a document's extraction as JSON. The rules below say where names stand, what they
are of and how the document is tied to them; every record gives an array of edges, which is
taken apart once. Nodes of names are told by label and name, for resolution to merge; results,
items and policies are nodes of their own document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.functions import names as N
from loamgraph.operators import names as M
from loamgraph.sources.bindings import table

#: Confidence below which an extracted entity or relationship is left out.
LEAST = 0.5
EDGE = "array<struct<src_label string, src string, rel_type string, label string, name string, props string, confidence double, implied boolean, check string>>"

# Where a document's type names someone, what that is, and the edge from the document.
NAMED = {
    "medical_lab": [("patient_name", "Person", "PATIENT_OF"), ("provider", "Organization", "PROVIDER_FOR"), ("ordering_physician", "Person", "AUTHORED_BY")],
    "financial_invoice": [("vendor", "Organization", "INVOICED_BY")],
    "insurance": [("provider", "Organization", "PROVIDER_FOR"), ("policyholder", "Person", "COVERS")],
    "government_tax": [("filer_name", "Person", "AUTHORED_BY"), ("preparer", "Person", "PREPARED_BY")],
    "military": [("service_member", "Person", "SERVICE_RECORD_OF"), ("branch", "Organization", "BRANCH_OF_SERVICE"), ("unit", "Organization", "ASSIGNED_TO"), ("base", "Location", "STATIONED_AT")],
    "property_home": [("property_address", "Address", "LOCATED_AT")],
}
# Lists of names, by type.
LISTED = {
    "medical_lab": [("diagnoses", "Condition", "DIAGNOSED_WITH")],
    "military": [("conditions", "Condition", "DIAGNOSED_WITH"), ("organizations", "Organization", "MENTIONS")],
    "property_home": [("parties", "Person", "MENTIONS")],
    "generic": [("people", "Person", "MENTIONS"), ("organizations", "Organization", "MENTIONS")],
}
# Nodes that a document makes of its own: label, properties and where they stand.
MADE = {
    "financial_invoice": ("FinancialItem", {"amount": "total_amount", "date": "date", "reference_number": "invoice_number", "currency": "currency", "payment_status": "payment_status"}),
    "legal_contract": ("Contract", {"type": "contract_type", "effective_date": "effective_date", "expiration_date": "expiration_date", "terms_summary": "terms_summary", "renewal_info": "renewal_info"}),
    "insurance": ("InsurancePolicy", {"policy_number": "policy_number", "provider": "provider", "coverage_type": "coverage_type", "premium": "premium", "effective_date": "effective_date", "expiration_date": "expiration_date"}),
    "government_tax": ("FinancialItem", {"type": "form_type", "amount": "total_income", "date": "tax_year", "reference_number": "form_type", "filing_status": "filing_status", "tax_owed": "tax_owed", "tax_paid": "tax_paid"}),
}
# The same for each element of a list.
MADE_EACH = {
    "medical_lab": ("tests", "MedicalResult", {"test_name": "name", "value": "value", "unit": "unit", "reference_range": "reference_range", "flag": "flag"}, "name"),
    "military": ("disability_ratings", "MedicalResult", {"test_name": "condition", "value": "percentage", "flag": "status", "effective_date": "effective_date"}, "condition"),
}
# Parts of names that tell organisations from persons, in contracts and in relationships.
COMPANIES = ["inc", "llc", "corp", "company", "ltd", "agency", "dept", "department"]
INSTITUTIONS = ["inc", "llc", "corp", "dept", "department", "agency", "company", "bank", "university"]
PERSON_TO_CONDITION = {"medical_lab": ("patient_name", "diagnoses"), "military": ("service_member", "conditions")}


def _at(record: Column, path: str) -> Column:
    x = F.trim(F.get_json_object(record, f"$.{path}"))
    return F.when(x != "", x)


def _list(record: Column, path: str) -> Column:
    """Elements of a list as texts: strings as they are, objects as JSON."""
    return F.coalesce(F.from_json(F.get_json_object(record, f"$.{path}"), "array<string>"), F.array().cast("array<string>"))


def _name(element: Column) -> Column:
    return F.when(F.startswith(element, F.lit("{")), _at(element, "name")).otherwise(F.trim(element))


def _edge(rel: Column, label: Column, name: Column, props: Column | None = None, confidence: Column | None = None, src: Column | None = None, src_label: Column | None = None, implied: bool = False, check: str = "name") -> Column:
    """check: what is judged once edges are apart: ``name``, ``both`` ends, ``place`` (a name, but no address) or nothing."""
    return F.struct(
        (F.lit("Document") if src_label is None else src_label).alias("src_label"), (F.lit(None).cast("string") if src is None else src).alias("src"), rel.alias("rel_type"), label.alias("label"), name.alias("name"),
        (F.lit(None).cast("string") if props is None else props).alias("props"), (F.lit(None).cast("double") if confidence is None else confidence.cast("double")).alias("confidence"), F.lit(implied).alias("implied"), F.lit(check).alias("check"),
    )


def _some(test: Column, edges: Column) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), edges).otherwise(F.array().cast(EDGE))


def _any(name: Column, parts: list[str]) -> Column:
    return F.lower(name).rlike("|".join(parts))


def _props(record: Column, fields: dict[str, str]) -> Column:
    return F.to_json(F.struct(*[F.coalesce(_at(record, path), F.lit("")).alias(k) for k, path in fields.items()]))


def _confident(element: Column, default: float) -> Column:
    return F.coalesce(F.get_json_object(element, "$.confidence").try_cast("double"), F.lit(default))


def _listed(names: Column, label: str, rel: str) -> Column:
    return F.transform(names, lambda e: _edge(F.lit(rel), F.lit(label), _name(e)))


def _of_type(kind: str, record: Column, own: Column) -> Column:
    """Edges of a document of one type; ``own`` begins the names of nodes it makes."""
    lit = F.lit
    out = [_some(_at(record, path).isNotNull(), F.array(_edge(lit(rel), lit(label), _at(record, path)))) for path, label, rel in NAMED.get(kind, [])]
    for path, label, rel in LISTED.get(kind, []):
        fit = F.filter(_list(record, path), lambda e: _confident(e, 1.0) >= LEAST)
        out.append(_listed(fit, label, rel))
    if kind == "legal_contract":
        role = lambda e: F.lower(F.coalesce(_at(e, "role"), lit("")))
        rel = lambda e: F.when(role(e).rlike("sign|execute|enter"), "CONTRACTED_WITH").otherwise("PARTY_TO")
        out.append(F.transform(_list(record, "parties"), lambda e: _edge(rel(e), F.when(_any(_name(e), COMPANIES), "Organization").otherwise("Person"), _name(e))))
    if kind == "military":
        context = lambda e: F.lower(F.coalesce(_at(e, "context"), lit("")))
        out.append(F.transform(_list(record, "locations"), lambda e: _edge(F.when(F.contains(context(e), lit("deploy")), "DEPLOYED_TO").when(F.contains(context(e), lit("station")), "STATIONED_AT").otherwise("LOCATED_AT"), lit("Location"), _name(e), check="place")))
    if kind in PERSON_TO_CONDITION:
        person, path = PERSON_TO_CONDITION[kind]
        out.append(F.transform(_list(record, path), lambda e: _edge(lit("HAS_CONDITION"), lit("Condition"), _name(e), src=_at(record, person), src_label=lit("Person"), check="both")))
    if kind in MADE:
        label, fields = MADE[kind]
        needed = _at(record, "total_amount").isNotNull() if kind == "financial_invoice" else lit(True)
        out.append(_some(needed, F.array(_edge(lit("CONTAINS_RESULT"), lit(label), F.concat(own, lit(f"/{label}")), _props(record, fields), check="own"))))
    if kind in MADE_EACH:
        path, label, fields, need = MADE_EACH[kind]
        fit = F.filter(_list(record, path), lambda e: _at(e, need).isNotNull() & (_confident(e, 1.0) >= LEAST))
        out.append(F.transform(fit, lambda e, i: _edge(lit("CONTAINS_RESULT"), lit(label), F.concat(own, lit(f"/{path}/"), i.cast("string")), _props(e, fields), _confident(e, 1.0), check="own")))
    return F.concat(*out)


def edges(records: DataFrame) -> DataFrame:
    """document_id, src_label, src, rel_type, label, name, props, confidence, implied of records (document_id, doc_type, record: JSON).

    src is null where the document itself is the source. Entities of ``all_entities`` and ties of
    ``implied_relationships`` (see combined()) come from any type; unknown types are generic, and a
    generic document with all_entities names no one else. Invalid names, dates taken for events and
    what is less sure than LEAST are left out; broken and null records give nothing.
    """
    r, own = F.col("record"), F.concat(F.lit("doc-"), F.col("document_id").cast("string"))
    everyone = _list(r, "all_entities")
    kind = lambda e: F.coalesce(_at(e, "type"), F.lit("Person"))
    sure = F.filter(everyone, lambda e: _confident(e, 0.8) >= LEAST)
    label = lambda t: F.when(t == "Document", "DocumentRef").otherwise(t)
    mentioned = F.transform(sure, lambda e: _edge(F.lit("MENTIONS"), label(kind(e)), _name(e), confidence=_confident(e, 0.8)))
    ties = F.filter(_list(r, "implied_relationships"), lambda e: _confident(e, 0.5) >= LEAST)
    tied = F.transform(ties, lambda e: _edge(F.coalesce(_at(e, "relationship"), F.lit("RELATED_TO")), label(F.coalesce(_at(e, "to_type"), F.lit("Person"))), _at(e, "to_entity"), None, _confident(e, 0.5), _at(e, "from_entity"), label(F.coalesce(_at(e, "from_type"), F.lit("Person"))), True, "both"))
    by_type = _some(F.size(everyone) == 0, _of_type("generic", r, own))
    for name in ("medical_lab", "financial_invoice", "legal_contract", "insurance", "government_tax", "military", "property_home"):
        by_type = F.when(F.col("doc_type") == name, _of_type(name, r, own)).otherwise(by_type)
    found = F.concat(mentioned.cast(EDGE), by_type.cast(EDGE), tied.cast(EDGE))
    apart = records.filter("record IS NOT NULL").select("document_id", F.explode(found).alias("e")).select("document_id", "e.*")
    fits = N.valid_entity_name(F.col("name")) & ~((F.col("check") == "place") & N.full_address(F.col("name"))) & ~((F.col("label") == "Event") & N.date_string(F.col("name")))
    apart = apart.withColumn("fits", (F.col("check") == "own") | fits).filter(F.coalesce("fits", F.lit(False)))
    apart = apart.withColumn("fits", (F.col("check") != "both") | N.valid_entity_name(F.col("src"))).filter(F.coalesce("fits", F.lit(False)))
    return apart.withColumn("rel_type", N.relation_type(F.col("rel_type"))).drop("check", "fits")


def combined(passes: DataFrame) -> DataFrame:
    """document_id, doc_type, record, confidence of three passes (metadata: JSON; entities, relationships: JSON lists).

    The record is the metadata with people and organizations of the entities, relationships with
    the types that entities of these names have first (or seem to have), and all entities. The
    confidence is the mean of the entities that state one other than 0, else 0.8.
    """
    entities = F.filter(_list(F.col("doc"), "entities"), lambda e: _at(e, "name").isNotNull())
    out = passes.withColumn("doc", F.concat(F.lit('{"entities":'), F.coalesce("entities", F.lit("[]")), F.lit(',"relationships":'), F.coalesce("relationships", F.lit("[]")), F.lit("}")))
    out = out.withColumn("e", F.transform(entities, lambda e: F.struct(_at(e, "name").alias("name"), F.coalesce(_at(e, "type"), F.lit("Person")).alias("type"), F.coalesce(_at(e, "description"), F.lit("")).alias("description"), _confident(e, 0.8).alias("confidence"))))
    of = lambda t, k: F.transform(F.filter("e", lambda x: x["type"] == t), lambda x: F.struct(x["name"].alias("name"), x["description"].alias(k), x["confidence"].alias("confidence")))
    typed = lambda n: F.coalesce(F.get(F.filter("e", lambda x: x["name"] == n), F.lit(0))["type"], F.when(_any(n, INSTITUTIONS), "Organization").otherwise("Person"))
    ties = F.filter(_list(F.col("doc"), "relationships"), lambda e: _at(e, "from_entity").isNotNull() & _at(e, "to_entity").isNotNull())
    tie = lambda x: F.struct(_at(x, "from_entity").alias("from_entity"), typed(_at(x, "from_entity")).alias("from_type"), _at(x, "to_entity").alias("to_entity"), typed(_at(x, "to_entity")).alias("to_type"), F.coalesce(_at(x, "relationship_type"), F.lit("RELATED_TO")).alias("relationship"), _confident(x, 0.7).alias("confidence"))
    added = F.to_json(F.struct(of("Person", "role").alias("people"), of("Organization", "type").alias("organizations"), F.transform(ties, tie).alias("implied_relationships"), F.col("e").alias("all_entities")))
    # Added fields come first: a path takes the first of two fields of one name.
    own = F.regexp_replace(F.trim(F.coalesce("metadata", F.lit("{}"))), r"^\{\s*", "")
    record = F.when(own == "}", added).otherwise(F.concat(F.regexp_replace(added, r"\}$", ","), own))
    stated = F.filter("e", lambda x: x["confidence"] != 0)
    mean = F.when(F.size(stated) > 0, F.aggregate(stated, F.lit(0.0), lambda a, x: a + x["confidence"]) / F.size(stated)).otherwise(0.8)
    return out.select("document_id", "doc_type", record.alias("record"), F.round(mean, 6).alias("confidence"))


def primary_date(record: Column, created: Column) -> Column:
    """The first of a record's date and effective date, else the day a document was created, else empty."""
    return F.coalesce(_at(record, "date"), _at(record, "effective_date"), F.substring(created, 1, 10), F.lit(""))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales as extractions: invoices, contracts and policies by status, of clients and the vendors of their first lines."""
    sales = table(spark, sf_dir, "sales").groupBy("sale_id").agg(F.min(F.struct("client_id", "status", "total", F.date_format("sold_at", "yyyy-MM-dd").alias("day"))).alias("s")).select("sale_id", "s.*")
    clients = table(spark, sf_dir, "clients").groupBy("client_id").agg(F.min("name").alias("client"))
    vendors = table(spark, sf_dir, "vendors").groupBy("vendor_id").agg(F.min("name").alias("vendor"))
    first = table(spark, sf_dir, "sale_lines").groupBy("sale_id").agg(F.min("vendor_id").alias("vendor_id"))
    all_ = sales.filter("sale_id IS NOT NULL").join(clients, "client_id", "left").join(first, "sale_id", "left").join(vendors, "vendor_id", "left")
    kind = F.when(F.col("status") == "done", "financial_invoice").when(F.col("status") == "open", "legal_contract").otherwise("insurance")
    party = lambda name, role: F.struct(F.col(name).alias("name"), F.lit(role).alias("role"))
    record = F.struct(F.col("vendor"), F.col("total").cast("long").alias("total_amount"), F.col("day").alias("date"), F.array(party("client", "signs"), party("vendor", "seller")).alias("parties"), F.col("vendor").alias("provider"), F.col("client").alias("policyholder"), F.lit("sale").alias("contract_type"))
    return all_.select(F.col("sale_id").alias("document_id"), kind.alias("doc_type"), F.to_json(record).alias("record"))


def extraction_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edges(_records(spark, sf_dir))
    return found.select("document_id", "src_label", "rel_type", "label", F.when(F.col("name").startswith("doc-"), F.lit("own")).otherwise(F.col("name")).alias("name"), F.get_json_object("props", "$.amount").alias("amount"))


QUERIES = {"extraction_edges": extraction_edges}
_EDGES = """WITH s AS (SELECT sale_id, client_id, status, total FROM (SELECT *, strftime(sold_at, '%Y-%m-%d') AS day FROM sales WHERE sale_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY sale_id ORDER BY client_id NULLS FIRST, status NULLS FIRST, total NULLS FIRST, day NULLS FIRST) = 1),
c AS (SELECT client_id, min(name) AS client FROM clients GROUP BY 1), v AS (SELECT vendor_id, min(name) AS vendor FROM vendors GROUP BY 1), f AS (SELECT sale_id, min(vendor_id) AS vendor_id FROM sale_lines GROUP BY 1),
r AS (SELECT s.sale_id AS document_id, coalesce(status, '') AS status, total, trim(client) AS client, trim(vendor) AS vendor FROM s LEFT JOIN c USING (client_id) LEFT JOIN f USING (sale_id) LEFT JOIN v USING (vendor_id)),
named AS (SELECT document_id, 'INVOICED_BY' AS rel_type, 'Organization' AS label, vendor AS name FROM r WHERE status = 'done'
UNION ALL SELECT document_id, 'CONTRACTED_WITH', NULL, client FROM r WHERE status = 'open' UNION ALL SELECT document_id, 'PARTY_TO', NULL, vendor FROM r WHERE status = 'open'
UNION ALL SELECT document_id, 'PROVIDER_FOR', 'Organization', vendor FROM r WHERE status NOT IN ('done', 'open') UNION ALL SELECT document_id, 'COVERS', 'Person', client FROM r WHERE status NOT IN ('done', 'open')),
made AS (SELECT document_id, CASE status WHEN 'done' THEN 'FinancialItem' WHEN 'open' THEN 'Contract' ELSE 'InsurancePolicy' END AS label, CASE WHEN status = 'done' THEN trunc(total)::BIGINT::VARCHAR END AS amount FROM r WHERE status <> 'done' OR total IS NOT NULL)
SELECT document_id, 'Document' AS src_label, rel_type, coalesce(label, CASE WHEN regexp_matches(lower(name), '""" + "|".join(COMPANIES) + """') THEN 'Organization' ELSE 'Person' END) AS label, name, NULL::VARCHAR AS amount FROM named WHERE name <> '' AND """ + M._VALID + """
UNION ALL SELECT document_id, 'Document', 'CONTAINS_RESULT', label, 'own', amount FROM made"""
ORACLE_SQL = {"extraction_edges": _EDGES}
