"""Edges from extracted records: golden rows for each type of document."""

import json

from pyspark.sql import functions as F

from loamgraph.operators import extraction as X

RECORDS = {
    ("medical_lab", 1): {"patient_name": "Ann Berg", "provider": "Lakeside Clinic", "ordering_physician": "Sam Hill", "tests": [{"name": "Glucose", "value": 91, "unit": "mg/dL"}, {"value": 3}, {"name": "Iron", "confidence": 0.2}], "diagnoses": ["Diabetes Mellitus", "x"]},
    ("financial_invoice", 2): {"vendor": "Acme Tools Inc", "total_amount": 12.5, "date": "2024-01-02", "currency": "EUR"},
    ("financial_invoice", 3): {"vendor": ""},
    ("legal_contract", 4): {"parties": [{"name": "Acme Tools Inc", "role": "Signs"}, {"name": "Ann Berg", "role": "buyer"}, {"role": "none"}], "contract_type": "lease"},
    ("insurance", 5): {"provider": "Shield Mutual", "policyholder": "Ann Berg", "policy_number": "P-1"},
    ("government_tax", 6): {"filer_name": "Ann Berg", "preparer": "Sam Hill", "form_type": "W-2", "tax_year": "2023"},
    ("military", 7): {"service_member": "Ann Berg", "branch": "Air Force", "disability_ratings": [{"condition": "Tinnitus", "percentage": 10}], "conditions": [{"name": "Back Strain"}], "locations": [{"name": "Ramstein", "context": "deployed to"}, "Lisbon"], "organizations": ["Base Command"]},
    ("property_home", 8): {"property_address": "12 Oak Street", "parties": [{"name": "Sam Hill"}]},
    ("generic", 9): {"people": [{"name": "Ann Berg", "confidence": 0.4}, "Sam Hill"], "organizations": [{"name": "Lakeside Clinic"}]},
    ("letter", 10): {"all_entities": [{"name": "Ann Berg", "type": "Person"}, {"name": "January 5, 2024", "type": "Event"}, {"name": "Shield Mutual", "type": "Document", "confidence": 0.9}], "people": ["Sam Hill"], "implied_relationships": [{"from_entity": "Ann Berg", "to_entity": "Shield Mutual", "to_type": "Organization", "relationship": "insured by", "confidence": 0.9}, {"from_entity": "Ann Berg", "to_entity": "Sam Hill", "confidence": 0.1}]},
}
GOLDEN = {
    1: {("PATIENT_OF", "Person", "Ann Berg"), ("PROVIDER_FOR", "Organization", "Lakeside Clinic"), ("AUTHORED_BY", "Person", "Sam Hill"), ("CONTAINS_RESULT", "MedicalResult", "doc-1/tests/0"), ("DIAGNOSED_WITH", "Condition", "Diabetes Mellitus"), ("HAS_CONDITION", "Condition", "Diabetes Mellitus")},
    2: {("INVOICED_BY", "Organization", "Acme Tools Inc"), ("CONTAINS_RESULT", "FinancialItem", "doc-2/FinancialItem")},
    4: {("CONTRACTED_WITH", "Organization", "Acme Tools Inc"), ("PARTY_TO", "Person", "Ann Berg"), ("CONTAINS_RESULT", "Contract", "doc-4/Contract")},
    5: {("PROVIDER_FOR", "Organization", "Shield Mutual"), ("COVERS", "Person", "Ann Berg"), ("CONTAINS_RESULT", "InsurancePolicy", "doc-5/InsurancePolicy")},
    6: {("AUTHORED_BY", "Person", "Ann Berg"), ("PREPARED_BY", "Person", "Sam Hill"), ("CONTAINS_RESULT", "FinancialItem", "doc-6/FinancialItem")},
    7: {("SERVICE_RECORD_OF", "Person", "Ann Berg"), ("BRANCH_OF_SERVICE", "Organization", "Air Force"), ("CONTAINS_RESULT", "MedicalResult", "doc-7/disability_ratings/0"), ("DIAGNOSED_WITH", "Condition", "Back Strain"), ("HAS_CONDITION", "Condition", "Back Strain"), ("DEPLOYED_TO", "Location", "Ramstein"), ("LOCATED_AT", "Location", "Lisbon"), ("MENTIONS", "Organization", "Base Command")},
    8: {("LOCATED_AT", "Address", "12 Oak Street"), ("MENTIONS", "Person", "Sam Hill")},
    9: {("MENTIONS", "Person", "Sam Hill"), ("MENTIONS", "Organization", "Lakeside Clinic")},
    10: {("MENTIONS", "Person", "Ann Berg"), ("MENTIONS", "DocumentRef", "Shield Mutual"), ("INSURED_BY", "Organization", "Shield Mutual")},
}


def test_golden_edges_of_each_type(spark):
    rows = [(i, kind, json.dumps(r)) for (kind, i), r in RECORDS.items()] + [(11, "insurance", None), (12, "medical_lab", "{broken"), (13, None, "{}")]
    found = X.edges(spark.createDataFrame(rows, "document_id long, doc_type string, record string")).collect()
    got = {}
    for r in found:
        got.setdefault(r.document_id, set()).add((r.rel_type, r.label, r["name"]))
    assert {i: g for i, g in got.items() if i < 11} == GOLDEN and len(found) == sum(map(len, got.values()))
    assert {(r.src_label, r.src) for r in found if r.rel_type in ("HAS_CONDITION", "INSURED_BY")} == {("Person", "Ann Berg")}
    item = next(r for r in found if r["name"] == "doc-2/FinancialItem")
    assert json.loads(item.props) == {"amount": "12.5", "date": "2024-01-02", "reference_number": "", "currency": "EUR", "payment_status": ""}
    assert [r.confidence for r in found if r.implied] == [0.9]


def test_passes_combine(spark):
    entities = [{"name": "Ann Berg", "type": "Person", "confidence": 0.9, "description": "patient"}, {"name": "Shield", "type": "Organization", "confidence": 0}, {"type": "Person"}, {"name": "Ann Berg", "type": "Contract", "confidence": 0.5}]
    ties = [{"from_entity": "Ann Berg", "to_entity": "First Bank", "relationship_type": "banks with"}, {"from_entity": "Shield", "to_entity": "Zoe"}, {"from_entity": "x"}]
    rows = [(1, "letter", json.dumps({"date": "2024-02-01", "people": "old"}), json.dumps(entities), json.dumps(ties)), (2, "letter", None, None, None)]
    out = X.combined(spark.createDataFrame(rows, "document_id long, doc_type string, metadata string, entities string, relationships string"))
    got = {r.document_id: r for r in out.withColumn("day", X.primary_date(F.col("record"), F.lit("2023-05-06T01"))).withColumn("people", F.get_json_object("record", "$.people[0].role")).withColumn("ties", F.get_json_object("record", "$.implied_relationships")).collect()}
    assert (got[1].confidence, got[1].day, got[1].people) == (0.7, "2024-02-01", "patient") and (got[2].confidence, got[2].day) == (0.8, "2023-05-06")
    assert [(t["from_type"], t["to_type"], t["relationship"], t["confidence"]) for t in json.loads(got[1].ties)] == [("Person", "Organization", "banks with", 0.7), ("Organization", "Person", "RELATED_TO", 0.7)]
