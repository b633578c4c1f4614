"""Names of entities: what counts as one, how they are normalised, and which of two is better."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamgraph.functions.questions import strings

# Names that are no entities, words and phrases that give such names away, titles, suffixes, types.
BLOCKED = [
    "subject matter expert", "candidates", "applicant", "customer", "client", "employee", "employer", "vendor", "buyer", "seller", "user", "admin", "recipient", "sender", "owner",
    "tenant", "landlord", "borrower", "lender", "insured", "beneficiary", "claimant", "plaintiff", "defendant", "taxpayer", "filer", "spouse", "dependent", "subscriber", "member",
    "patient", "provider", "physician", "doctor", "nurse", "contractor", "subcontractor", "consultant", "freelancer", "specialist", "n/a", "unknown", "none", "null", "other", "various",
    "multiple", "not specified", "not applicable", "see above", "see below", "labor", "parts", "deductible", "sublet", "subtotal", "total", "total due", "amount due", "balance due",
    "sales tax", "tax", "shop supplies", "hazardous materials", "discounts", "discount", "special order deposit", "deposit", "payment", "credit", "warranties", "warranty", "shipping",
    "freight", "handling", "miscellaneous", "misc", "other charges", "surcharge", "fee", "document storage fee", "processing fee", "service charge", "owner/operator", "owner operator",
    "authorized representative", "account holder", "primary contact", "secondary contact", "emergency contact", "next of kin", "power of attorney", "legal guardian", "authorized agent",
    "authorized user", "investigation request", "background investigations", "background investigation", "continuous evaluations", "personal interview", "investigation",
]
SMALL_WORDS = ["and", "or", "the", "a", "an", "in", "on", "at", "by", "for", "with", "to", "of"]
ROLE_PHRASES = ["matter expert", "representative", "contact person", "point of contact"]
GERUNDS = "soliciting verifying requesting processing providing submitting reviewing conducting performing completing maintaining obtaining ensuring managing handling".split()
ACRONYMS = ["FBI", "CIA", "IRS", "VA", "DOD", "NASA", "NCDOT", "DMV", "SSA", "USPS"]
TITLES = "dr mr mrs ms prof rev hon sgt cpl sra ssgt tsgt msgt smsgt cmsgt od md dds dvm d.v.m esq jr sr ii iii iv".split()
LEADING_SUFFIXES = ["llc", "inc", "corp", "ltd", "co", "the"]
ORG_SUFFIXES = (
    "inc llc ltd corp corporation co company group holdings enterprises partners lp llp plc sa ag gmbh pllc pa pc na fsb services service mortgage insurance financial bank banking lending "
    "solutions associates association foundation trust management consulting advisors advisory capital properties realty real estate of the and a"
).split()
ENTITY_TYPES = ["FinancialItem", "InsurancePolicy", "DateEvent", "DocumentRef", "MedicalResult", "Person", "Organization", "Location", "System", "Product", "Document", "Event", "Condition", "Contract", "Address"]
DATES = [r"^\w+ \d{1,2},? \d{4}$", r"^\d{1,2}/\d{1,2}/\d{2,4}$", r"^\d{4}-\d{2}-\d{2}$", r"^\d{1,2}-\d{1,2}-\d{2,4}$", r"^\w+ \d{4}$", r"^\d{4}$", r"^(?i:Q[1-4]|H[12])\s*\d{4}$"]
DATE_LABEL = r"^(?:Date of |R/O |In-Service |Delivery |Freight Bill |Setup |Expected date of )?\w*\s*(?:Date|date)?:?\s*"
DATE_RANGE = r"^\w+ \d{1,2},? \d{4}\s*[-–]\s*\w+ \d{1,2},? \d{4}$"
DATE_CODE = r"^[A-Z]{2,5}\s+(?:DTD\s+)?\d{1,2}/\d{1,2}/\d{2,4}$"
ADDRESSES = [r"^\d{5}(-\d{4})?$", r"(?i)^\d+\s+(N|S|E|W|North|South|East|West|NE|NW|SE|SW)?\s*\w+\s+(St|Ave|Blvd|Rd|Dr|Ln|Way|Ct|Pl|Hwy|Highway|Pkwy|Cir|Loop|Ter|Trail)\b"]
LONG_ADDRESSES = [(r"^\d+\s+\w+", 20), (r"\b\d{5}(-\d{4})?\b", 10)]
STEWARD_SUFFIXES = r"\b(inc|llc|l\.l\.c|co|company|corp|corporation|the)\b"


def words(x: Column) -> Column:
    """The parts between blanks."""
    return F.filter(F.split(F.trim(x), r"\s+"), lambda w: w != "")


def _any_match(x: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | x.rlike(p)
    return out


def _is_lower(x: Column) -> Column:
    return (F.lower(x) == x) & (F.upper(x) != x)


def _is_upper(x: Column) -> Column:
    return (F.upper(x) == x) & (F.lower(x) != x)


def valid_entity_name(name: Column) -> Column:
    """Neither generic nor a number, a role, a phrase in lower case, an action or a long code."""
    x = F.trim(F.coalesce(name, F.lit("")))
    low, w = F.lower(x), words(x)
    bad = (F.length(x) < 3) | low.isin(BLOCKED) | x.rlike(r"^[\d,.$]+$") | F.get(w, F.lit(0)).isNull()
    bad = bad | ((F.size(w) == 1) & (_is_lower(x) | low.isin(SMALL_WORDS)))
    for p in ROLE_PHRASES:
        bad = bad | F.contains(low, F.lit(p))
    bad = bad | ((F.size(w) >= 3) & F.forall(w, _is_lower)) | F.lower(F.get(w, F.lit(0))).isin(GERUNDS)
    bad = bad | (_is_upper(x) & (F.size(w) <= 2) & ~x.isin(ACRONYMS) & (F.length(x) > 10))
    return ~F.coalesce(bad, F.lit(True))


def date_string(name: Column) -> Column:
    bare = F.trim(F.regexp_replace(name, DATE_LABEL, ""))
    return _any_match(name, DATES) | ((bare != name) & (bare != "") & _any_match(bare, DATES)) | name.rlike(DATE_RANGE) | name.rlike(DATE_CODE)


def full_address(name: Column) -> Column:
    out = _any_match(name, ADDRESSES)
    for p, n in LONG_ADDRESSES:
        out = out | (name.rlike(p) & (F.length(name) > n))
    return out


def relation_type(x: Column) -> Column:
    """Letters, digits and underscores in upper case; RELATED_TO where nothing is left."""
    out = F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(x, F.lit(""))), "[^A-Z0-9]+", "_"), "^_+|_+$", "")
    return F.when(out == "", "RELATED_TO").otherwise(out)


def entity_type(x: Column) -> Column:
    """The canonical spelling of a type; others with each word's first letter in upper case."""
    low = F.lower(F.trim(x))
    title = F.array_join(F.transform(F.regexp_extract_all(low, F.lit("[a-z]+|[^a-z]+"), F.lit(0)), F.initcap), "")
    out = title
    for t in ENTITY_TYPES:
        out = F.when(low == t.lower(), t).otherwise(out)
    return out


def name(x: Column) -> Column:
    """'LAST, FIRST' turned round, marks as blanks, blanks as one."""
    parts = F.split(x, ",")
    turned = F.when(F.size(parts) == 2, F.concat(F.trim(parts[1]), F.lit(" "), F.trim(parts[0]))).otherwise(x)
    return F.trim(F.regexp_replace(F.regexp_replace(turned, r"[™®©.\-']", " "), r"\s+", " "))


def person_name(x: Column) -> Column:
    """Without leading titles."""
    clean = name(x)
    bare = F.regexp_replace(clean, rf"^(?i:(?:{'|'.join(t.replace('.', '[.]') for t in TITLES)})[.]* )+(?=.)", "")
    return F.regexp_replace(bare, r"^(?i:and) (?=.)", "")


def org_name(x: Column) -> Column:
    """With a suffix that stands first moved to the end."""
    w = F.split(name(x), " ")
    first = F.regexp_replace(w[0], ",+$", "")
    moved = F.concat(F.array_join(F.slice(w, F.lit(2), F.size(w)), " "), F.lit(" "), first)
    return F.when((F.size(w) > 1) & F.lower(first).isin(LEADING_SUFFIXES), moved).otherwise(name(x))


def parts(x: Column) -> Column:
    return F.filter(words(F.lower(name(x))), lambda w: F.length(w) > 1)


def distinctive(x: Column) -> Column:
    """Words of an organisation's name that are no common suffix."""
    return F.array_sort(F.array_except(parts(x), strings(ORG_SUFFIXES)))


def joint(x: Column) -> Column:
    """The names of the people that one string of more than three words holds, else the string itself.

    They stand on both sides of "&" or "and", a left one of at most two words then taking the last
    word of the right; or they are two names of two to four words in a row, the first ending in a
    word that the second holds too.
    """
    each = words(name(x))
    n, both = F.size(each), F.array_join(each, " ")
    pattern = r"^(.+?)\s+(?:&|(?i:and))\s+(.+)$"
    left, right = F.regexp_extract(both, pattern, 1), F.regexp_extract(both, pattern, 2)
    surname = F.element_at(words(right), -1)
    lends = (F.size(words(left)) <= 2) & (F.size(words(right)) >= 2) & ~F.array_contains(words(F.lower(left)), F.lower(surname))
    around = F.array(F.when(lends, F.concat(left, F.lit(" "), surname)).otherwise(left), right)

    lower = F.transform(each, lambda w: F.lower(w))
    ends = F.filter(F.array(*map(F.lit, (2, 3, 4))), lambda i: (n - i).between(2, 4) & (F.length(F.get(lower, i - 1)) >= 3) & F.array_contains(F.slice(lower, i + 1, F.greatest(n - i, F.lit(0))), F.get(lower, i - 1)))
    end = F.get(ends, F.lit(0))
    in_row = F.array(F.array_join(F.slice(each, F.lit(1), end), " "), F.array_join(F.slice(each, end + 1, n), " "))
    return F.when((n > 3) & both.rlike(pattern), around).when((n >= 5) & (F.size(ends) > 0), in_row).otherwise(F.array(x))


def steward_name(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), STEWARD_SUFFIXES, " "), "[^a-z0-9]+", " "))


def identifier(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"[^a-zA-Z0-9@.-]+", ""))


def _quality(x: Column) -> Column:
    n = F.trim(x)
    size = F.size(words(n))
    case = F.when(n == F.upper(n), 1).when(n == F.lower(n), 0).otherwise(2)
    return F.struct(size, case, F.when(n.rlike("[0-9#@&%]"), 0).otherwise(1), F.when(size >= 3, 1).otherwise(0), F.length(n))


def canonical(a: Column, b: Column) -> Column:
    """The name with more parts, better case, cleaner signs, a middle name, more letters; the first if alike."""
    return F.when(_quality(a) >= _quality(b), a).otherwise(b)
