"""Rules over questions: mode, domain, need of a current state, sub-questions, entity types, concepts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.functions import text as T

# Terms of domains, of questions that need the latest state, of high stakes and of broad questions.
DOMAINS = {
    "insurance": ["insurance", "policy", "coverage", "premium", "deductible", "carrier", "declaration"],
    "tax": ["tax", "irs", "return", "w-2", "w2", "1099", "k-1", "schedule"],
    "mortgage": ["mortgage", "loan", "escrow", "servicer", "statement", "home loan"],
    "medical": ["medical", "doctor", "diagnosis", "medication", "lab", "provider", "prescription", "health"],
    "vehicle": ["vehicle", "auto", "car", "truck", "vin", "registration", "title"],
    "legal": ["contract", "legal", "lease", "agreement", "settlement"],
    "financial": ["bank", "account", "balance", "statement", "finance", "financial", "invoice"],
    "military": ["military", "va", "veteran", "disability", "rating", "orders", "dd-214", "service"],
    "property": ["property", "deed", "home", "house", "address", "utility"],
}
CURRENT_DOMAINS = ["insurance", "tax", "mortgage", "medical", "vehicle", "legal", "financial", "military"]
HIGH_STAKES_DOMAINS = ["medical", "tax", "insurance", "legal", "financial", "mortgage", "military"]
HIGH_STAKES = ["medical", "blood", "lab", "doctor", "diagnosis", "tax", "irs", "insurance", "policy", "deductible", "mortgage", "loan", "contract", "legal", "lease", "bank", "account", "balance", "va", "disability"]
SENSITIVE = [
    "insurance", "policy", "coverage", "premium", "deductible", "medical", "health", "doctor", "diagnosis", "medication", "prescription",
    "tax", "irs", "return", "w2", "1099", "mortgage", "loan", "balance", "finance", "financial", "bank", "account", "contract", "legal", "lease", "rating", "disability", "va",
]
BROAD = [
    "all ", "every ", "complete list", "comprehensive", "everything", "all the", "all my", "all of my", "each ", "full list", "recurring", "obligations", "summary of", "overview of",
    "what do i owe", "what do i pay", "what are my", "how much do i", "compare", "comparison", "breakdown of", "total ",
]
SEVERAL = [" and ", " including ", ", ", " or "]
DOC_TYPES = {
    "insurance": ["insurance", "policy", "declaration"],
    "tax": ["tax", "w2", "1099", "return"],
    "mortgage": ["mortgage", "statement", "loan"],
    "medical": ["medical", "lab", "visit", "prescription"],
    "vehicle": ["vehicle", "registration", "title", "insurance"],
    "legal": ["contract", "agreement", "legal"],
    "financial": ["statement", "invoice", "financial"],
    "military": ["military", "va", "service"],
    "property": ["property", "deed", "utility", "insurance"],
}
LATEST = "latest current final most recent updated revised effective expiration"
INVENTORY = "documents policy statement record amount date"
TIMELINE_DATES = "effective date expiration date statement period revision history chronological"
SOURCE_QUALITY = "original source document exact values effective dates statement period"
CONTRADICTION = "corrected revised superseded previous conflicting updated"
# Signals of entity types, and the types that a broad question adds.
SIGNALS = [
    ("bill payment financial obligation recurring monthly expense mortgage loan subscription utility owe pay cost fee charge balance statement account bank credit".split(), ["FinancialItem", "Contract"]),
    ("insurance policy coverage premium deductible claim insured underwriter liability".split(), ["InsurancePolicy"]),
    (["medical", "health", "diagnosis", "condition", "disability", "medication", "treatment", "doctor", "hospital", "va ", "veteran", "rating", "vaccine", "immunization", "lab", "blood", "test result", "prescription", "surgery", "dental", "vision", "therapy", "physical"], ["MedicalResult", "Condition"]),
    (["mower", "vehicle", "car", "truck", "device", "appliance", "manual", "instructions", "oil change", "maintenance", "repair", "equipment", "tool", "machine", "model", "serial number", "warranty"], ["Product", "System"]),
    ("contract agreement lease terms deed legal court attorney settlement notarized signed".split(), ["Contract", "DocumentRef"]),
    (["when did", "date", "timeline", "history", "deployment", "service record", "stationed", "assigned", "milestone", "ceremony", "graduation"], ["DateEvent", "Event"]),
    ("where location address stationed deployed lived moved residence city state base".split(), ["Location", "Address"]),
    (["property", "house", "home", "real estate", "mortgage", "escrow", "hoa", "homeowner"], ["Address", "Contract", "FinancialItem"]),
    ("who person people family contact employee spouse dependent beneficiary".split(), ["Person"]),
    ("company employer provider vendor agency organization".split(), ["Organization"]),
]
BROAD_WORDS = "all every everything comprehensive complete".split()
BROAD_TYPES = ["FinancialItem", "InsurancePolicy", "Contract", "MedicalResult"]
# Groups of words that stand for one another.
CONCEPTS = [
    "level levels result results value values amount amounts balance total score range status".split(),
    "latest last recent current newest final updated revised effective expiration expires".split(),
    "payment payments installment installments due premium charge fee invoice receipt statement".split(),
    "coverage policy contract agreement declaration terms benefit benefits".split(),
    "identifier number id account policy claim case reference serial vin ein ssn sku".split(),
    "income tax return w2 1099 k1 schedule".split(),
    "record report summary document source form notice".split(),
]


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def hits(text: Column, terms: list[str]) -> Column:
    """How many of these terms a text holds as substrings."""
    return reduce(lambda a, b: a + b, [F.contains(F.lower(text), F.lit(t)).cast("int") for t in terms])


def normalize_mode(mode: Column) -> Column:
    m = F.lower(F.coalesce(F.when(mode != "", mode), F.lit("deep")))
    return F.when(m.isin("fast", "quick"), "quick").when(m.isin("high_accuracy", "high-stakes", "high_stakes", "strict"), "strict").when(m == "timeline", "timeline").otherwise("deep")


def domain(question: Column) -> Column:
    """The domain with most terms; insurance wins its ties, ties of three domains or more are mixed."""
    found = F.array(*[F.struct((-hits(question, terms)).alias("s"), F.lit(i).alias("o"), F.lit(d).alias("d")) for i, (d, terms) in enumerate(DOMAINS.items())])
    found = F.array_sort(F.filter(found, lambda x: x["s"] < 0))
    first, second = F.get(found, F.lit(0)), F.get(found, F.lit(1))
    return F.when(F.size(found) == 0, "general").when((first["d"] != "insurance") & (F.size(found) > 2) & (first["s"] == second["s"]), "mixed").otherwise(first["d"])


def intent(question: Column, mode: Column) -> Column:
    return F.when(mode == "timeline", "timeline").otherwise(T.intent(question))


def requires_current(question: Column, domain_: Column, intent_: Column) -> Column:
    return intent_.isin("current_state", "timeline") | T.contains_any(question, T.CURRENT) | domain_.isin(CURRENT_DOMAINS)


def high_stakes(question: Column, domain_: Column) -> Column:
    return domain_.isin(HIGH_STAKES_DOMAINS) | T.contains_any(question, HIGH_STAKES)


def requires_latest(question: Column) -> Column:
    return T.contains_any(question, SENSITIVE)


def broad(question: Column) -> Column:
    n = hits(question, BROAD)
    return (n >= 1) & (T.contains_any(question, SEVERAL) | (n >= 2))


def required_doc_types(domain_: Column) -> Column:
    out = strings([])
    for d, types in DOC_TYPES.items():
        out = F.when(domain_ == d, strings(types)).otherwise(out)
    return out


def deduped(subqueries: Column) -> Column:
    """(role, query) structs without blank queries, the first of each query whatever its case, at most eight."""
    clean = F.filter(F.transform(subqueries, lambda x: F.struct(F.coalesce(F.when(x["role"] != "", x["role"]), F.lit("planned")).alias("role"), F.trim(x["query"]).alias("query"))), lambda x: x["query"] != "")
    seen = lambda kept, x: F.exists(kept, lambda y: F.lower(y["query"]) == F.lower(x["query"]))
    first = F.aggregate(clean, F.array().cast("array<struct<role:string,query:string>>"), lambda kept, x: F.when(seen(kept, x), kept).otherwise(F.array_append(kept, x)))
    return F.slice(first, 1, 8)


def _planned(question: Column, mode: Column, domain_: Column, intent_: Column, current: Column) -> Column:
    sub = lambda role, query: F.struct(F.lit(role).alias("role"), query.alias("query"))
    behind = lambda words: F.concat(question, F.lit(" " + words))
    none = F.lit(None).cast("struct<role:string,query:string>")
    deep = mode != "quick"
    return F.array_compact(
        F.array(
            sub("primary", question),
            F.when(deep & current, sub("current_state", behind(LATEST))).otherwise(none),
            F.when(deep & (domain_ != "general"), sub("domain_inventory", F.concat(domain_, F.lit(f" {INVENTORY} "), question))).otherwise(none),
            F.when(deep & (intent_ == "timeline"), sub("timeline_dates", behind(TIMELINE_DATES))).otherwise(none),
            F.when(mode == "strict", sub("source_quality", behind(SOURCE_QUALITY))).otherwise(none),
            F.when(mode == "strict", sub("contradiction_check", behind(CONTRADICTION))).otherwise(none),
        )
    )


def with_retrieval_queries(questions: DataFrame) -> DataFrame:
    """questions (text, mode: normalised) with ``asked``: the sub-questions, one, six or eight by mode, with one for the current state where it is needed. Step by step, as each step is used many times by the next."""
    out = questions.withColumn("_domain", domain(F.col("text"))).withColumn("_intent", intent(F.col("text"), F.col("mode")))
    out = out.withColumn("_current", requires_current(F.col("text"), F.col("_domain"), F.col("_intent")))
    out = out.withColumn("_asked", _planned(F.col("text"), F.col("mode"), F.col("_domain"), F.col("_intent"), F.col("_current"))).withColumn("_asked", deduped(F.col("_asked")))
    wants = F.col("_current") & ~F.exists("_asked", lambda x: x["role"] == "current_state")
    latest = F.struct(F.lit("current_state").alias("role"), F.trim(F.concat(F.get("_asked", F.lit(0))["query"], F.lit(" " + LATEST))).alias("query"))
    most = F.when(F.col("mode") == "quick", 1).when(F.col("mode") == "strict", 8).otherwise(6)
    asked = F.slice(F.when(wants & (F.size("_asked") > 0), F.array_append("_asked", latest)).otherwise(F.col("_asked")), F.lit(1), most)
    return out.withColumn("asked", asked).drop("_domain", "_intent", "_current", "_asked")


def entity_types(question: Column) -> Column:
    """Types of entities that a question asks for, sorted."""
    found = F.array_distinct(F.concat(*[F.when(T.contains_any(question, words), strings(types)).otherwise(strings([])) for words, types in SIGNALS]))
    more = T.contains_any(question, BROAD_WORDS) & (F.size(found) < 3)
    return F.array_sort(F.array_distinct(F.when(more, F.concat(found, strings(BROAD_TYPES))).otherwise(found)))


def concept_terms(question: Column) -> Column:
    """Terms of three letters or more, with and without a plural s, and the groups of concepts that they meet, one after another; sorted."""
    terms = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(question), F.lit("[a-z0-9$]+"), F.lit(0)), lambda x: F.length(x) >= 3))
    other = F.transform(terms, lambda x: F.when(F.endswith(x, F.lit("s")) & (F.length(x) > 3), F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(F.concat(x, F.lit("s"))))
    out = F.array_union(terms, other)
    for group in CONCEPTS:
        out = F.when(F.arrays_overlap(out, strings(group)), F.array_union(out, strings(group))).otherwise(out)
    return F.array_sort(out)


# The same in SQL, for the oracle.
def sql_hits(x: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"contains(lower({x}), '{t}')::INT" for t in terms) + ")"


def sql_domain(x: str) -> str:
    found = "list_sort(list_filter([" + ", ".join(f"{{'s': -{sql_hits(x, terms)}, 'o': {i}, 'd': '{d}'}}" for i, (d, terms) in enumerate(DOMAINS.items())) + "], lambda y: y.s < 0))"
    return f"(SELECT CASE WHEN len(f) = 0 THEN 'general' WHEN f[1].d <> 'insurance' AND len(f) > 2 AND f[1].s = f[2].s THEN 'mixed' ELSE f[1].d END FROM (SELECT {found} AS f))"
