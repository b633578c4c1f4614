"""Structured facts in a text, and the quality of a source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamgraph.functions import text as T

# Terms of original and of summary documents, and patterns of facts.
DIRECT = ["laboratory report", "lab report", "diagnostic report", "statement", "declaration", "policy", "contract", "agreement", "return", "w-2", "w2", "1099", "k-1", "invoice", "receipt", "discharge summary"]
SUMMARY = ["summary", "portal", "patient health summary", "overview"]
NUMERIC = r"(?i)(?:\$\s*\d[\d,]*(?:\.\d+)?|\b\d[\d,]*(?:\.\d+)?\s*(?:%|[a-z]{1,8}(?:/[a-z]{1,8})?|months?|years?|days?|miles?|gallons?|kwh|sq\.?\s*ft\.?)\b)"
IDENTIFIER = (
    r"(?i)\b(?:(?:account|acct|policy|invoice|claim|case|reference|ref|serial|vin|ein|ssn|routing|member|customer|order|id)\s*(?:number|no\.?|#)?\s*[:#-]?\s*[a-z0-9][a-z0-9-]{2,}"
    r"|[a-z]{1,6}[- ]?\d{2,}[a-z0-9-]*|(?=[a-hj-npr-z0-9]{8,17}\b)(?=[a-hj-npr-z0-9]*\d)[a-hj-npr-z0-9]+)\b"
)
LABELLED = r"\b[A-Za-z][A-Za-z0-9 /()%.-]{2,50}:\s*\$?\d"


def table_rows(x: Column) -> Column:
    """Lines that begin with a bar and have another."""
    lines = F.split(x, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]")
    return F.size(F.filter(lines, lambda y: y.rlike(r"^\s*\|") & (F.length(y) - F.length(F.replace(y, F.lit("|"), F.lit(""))) >= 2)))


def count(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit(pattern))


def structured_facts(x: Column) -> Column:
    """Table rows, numbers with units, identifiers and labelled values; at most 80."""
    return F.least(F.lit(80), table_rows(x) + count(x, NUMERIC) + count(x, IDENTIFIER) + count(x, LABELLED))


def source_quality(title: Column, doc_type: Column, content: Column) -> Column:
    """(score, tier): originals above summaries above requests."""
    head = F.lower(F.concat_ws(" ", title, doc_type, F.substring(content, 1, 1200)))
    direct, summary = T.contains_any(head, DIRECT), T.contains_any(head, SUMMARY)
    request = F.contains(head, F.lit("requisition")) & ~F.contains(head, F.lit("result"))
    score = F.when(direct, 0.88).otherwise(0.55)
    score = F.when(summary, F.least(score, F.lit(0.68))).otherwise(score)
    score = F.when(request, F.least(score, F.lit(0.45))).otherwise(score)
    structured = F.substring(content, 1, 2000).rlike(r"\|.*\|") | (structured_facts(F.substring(content, 1, 3000)) > 0)
    score = score + F.when(F.coalesce(doc_type, F.lit("")) != "", 0.03).otherwise(0.0) + F.when(structured, 0.06).otherwise(0.0)
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3)
    tier = F.when(request, "request").when(summary, "summary").when(direct, "original").otherwise("context")
    tier = F.when((score >= 0.82) & (tier == "context"), "original").when((score >= 0.66) & (tier == "context"), "direct").when((score < 0.5), "weak").otherwise(tier)
    return F.struct(score.alias("score"), tier.alias("tier"))
