"""Dates in texts, as strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of dates by kind; each looks for a label, then takes what follows.
_DAY = r"([A-Z][a-z]+ \d{1,2}, \d{4}|\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{2}-\d{2})"
SIGNALS = {
    "specimen_date": r"\b(?:specimen|collected|collection)\s*(?:date|on)?[:\s]+" + _DAY,
    "reported_date": r"\b(?:reported|resulted|date of mailing|issue date)\s*(?:date|on)?[:\s]+" + _DAY,
    "service_date": r"\b(?:service date|date of service|visit date|dos)[:\s]+" + _DAY,
    "effective_date": r"\b(?:effective date|effective|policy period|coverage period)[:\s]+" + _DAY,
    "expiration_date": r"\b(?:expiration date|expires|through|to)[:\s]+" + _DAY,
    "statement_period": r"\b(?:statement period|billing period|period)[:\s]+([^\n]{6,80})",
    "document_date": r"^Date:\s*([^\n]+)",
}
MENTIONED = r"\b(20\d{2}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/20\d{2}|[A-Z][a-z]+ \d{1,2}, 20\d{2})\b"
MONTHS = "January February March April May June July August September October November December".split()


def _three(x: Column, pattern: str, order: tuple[int, int, int]) -> Column:
    y, m, d = (F.regexp_extract(x, pattern, i) for i in order)
    return F.when(y != "", F.concat(F.lpad(y, 4, "0"), F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0")))


def date_key(x: Column) -> Column:
    """A key that sorts: year-month-day, else month/day/year, else a year, else 9999."""
    year = F.regexp_extract(x, r"\b((?:19|20)\d{2})\b", 1)
    return F.coalesce(_three(x, r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})", (1, 2, 3)), _three(x, r"(\d{1,2})[-/](\d{1,2})[-/](\d{4})", (3, 1, 2)), F.when(year != "", year), F.lit("9999"))


def summary_date(x: Column) -> Column:
    """The first date of this century as year-month-day, null if there is none."""
    month = F.regexp_extract(x, r"\b([A-Z][a-z]+) (\d{1,2}), (20\d{2})\b", 1)
    number = F.array_position(F.array(*map(F.lit, MONTHS)), month)
    day, year = (F.regexp_extract(x, r"\b([A-Z][a-z]+) (\d{1,2}), (20\d{2})\b", i) for i in (2, 3))
    named = F.when(number > 0, F.concat(year, F.lit("-"), F.lpad(number.cast("string"), 2, "0"), F.lit("-"), F.lpad(day, 2, "0")))
    return F.coalesce(_three(x, r"\b(20\d{2})-(\d{2})-(\d{2})\b", (1, 2, 3)), _three(x, r"\b(\d{1,2})/(\d{1,2})/(20\d{2})\b", (3, 1, 2)), named)


def source_date(content: Column) -> Column:
    """What follows Date: at the start of a line; unknown counts as none."""
    x = F.trim(F.regexp_extract(content, r"(?m)^Date:\s*([^\n]+)", 1))
    return F.when((x != "") & (F.lower(x) != "unknown"), x)


def recency_boost(content: Column, as_of: Column) -> Column:
    """By the age of the date that the content begins a line with, on a stated day."""
    day = F.try_to_date(F.regexp_extract(content, r"(?m)^Date:\s*([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), "yyyy-MM-dd")
    age = F.when(day.isNotNull(), F.greatest(F.datediff(as_of, day), F.lit(0)))  # greatest() passes over nulls
    return F.when(age <= 90, 0.12).when(age <= 365, 0.08).when(age <= 730, 0.04).otherwise(0.0)


def signals(content: Column, title: Column, fallback: Column | None = None) -> Column:
    """Map of kind to distinct values in order, at most 8 of a kind and 12 mentioned; kinds without any lack."""
    text = F.concat(title, F.lit("\n"), F.coalesce(content, F.lit("")))
    entries = []
    for kind, pattern in SIGNALS.items():
        found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(f"(?im){pattern}"), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
        if kind == "document_date" and fallback is not None:
            found = F.concat(F.when(fallback != "", F.array(fallback)).otherwise(F.array().cast("array<string>")), found)
        entries.append(F.struct(F.lit(kind).alias("key"), F.slice(F.array_distinct(found), 1, 8).alias("value")))
    entries.append(F.struct(F.lit("mentioned_date").alias("key"), F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(MENTIONED), F.lit(1))), 1, 12).alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: F.size(e["value"]) > 0))
