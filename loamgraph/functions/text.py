"""Text as Column expressions: terms, trigrams, and rules over substrings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a question's terms leave out, and terms of the rules below.
STOPWORDS = (
    "a about an and answer are as at be by can could current did do document documents does for from had has have how "
    "i in into is it last latest level levels me my newest now of on or our show source sources the their this to was "
    "were what when where which who with would you your"
).split()
SUPERSEDED = ["superseded", "replaced by", "cancelled", "canceled", "expired", "void", "prior version"]
TIMELINE = ["timeline", "history", "progression", "changed", "over time", "chronological", "when", "effective", "expired", "expiration", "from", "to"]
CURRENT = ["current", "latest", "most recent", "active", "now", "today", "final", "updated", "newest", "what do i have", "what is my", "coverage", "balance", "premium", "status"]
COMPARE = ["compare", "difference", "versus", " vs ", "between"]
INVENTORY = ["all", "list", "inventory", "documents", "referenced"]
LATEST_SUFFIX = " latest current final most recent updated revised declaration statement policy"


def signal_terms(text: Column) -> Column:
    """Words of a-z and 0-9 in lower case, with their parts at - and / and without these."""
    raw = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+(?:[-/][a-z0-9]+)*"), F.lit(0))
    compact = F.transform(raw, lambda x: F.regexp_replace(x, "[-/]", ""))
    parts = F.flatten(F.transform(raw, lambda x: F.split(x, "[-/]")))
    return F.array_distinct(F.concat(raw, F.filter(F.concat(compact, parts), lambda x: F.length(x) >= 2)))


def query_terms(text: Column) -> Column:
    return F.filter(F.array_except(signal_terms(text), F.array(*map(F.lit, STOPWORDS))), lambda x: F.length(x) >= 2)


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words, two blanks before each and one after."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.concat(F.lit("  "), w, F.lit(" ")).substr(i, F.lit(3))))))


def contains_any(text: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(F.lower(text), F.lit(t))
    return out


def intent(question: Column) -> Column:
    rules = [("timeline", TIMELINE), ("current_state", CURRENT), ("compare", COMPARE), ("broad_inventory", INVENTORY)]
    out = F.lit("lookup")
    for name, terms in reversed(rules):
        out = F.when(contains_any(question, terms), name).otherwise(out)
    return out


# The same in SQL, for the oracle.
def sql_terms(x: str) -> str:
    raw = f"regexp_extract_all(lower({x}), '[a-z0-9]+(?:[-/][a-z0-9]+)*')"
    return f"list_distinct(list_concat({raw}, [y FOR y IN list_concat([regexp_replace(r, '[-/]', '', 'g') FOR r IN {raw}], flatten([string_split_regex(r, '[-/]') FOR r IN {raw}])) IF length(y) >= 2]))"


def sql_query_terms(x: str) -> str:
    return f"[t FOR t IN {sql_terms(x)} IF length(t) >= 2 AND NOT list_contains({STOPWORDS!r}, t)]"


def sql_trigrams(x: str) -> str:
    return rf"list_distinct(flatten([[substr('  ' || w || ' ', i, 3) FOR i IN range(1, length(w) + 2)] FOR w IN list_distinct(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+'))]))"


def sql_any(x: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), '{t}')" for t in terms) + ")"
