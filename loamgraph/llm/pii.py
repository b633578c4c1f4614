"""Personal data: detection by pattern, and information-theoretic sanitisation of what gives it away.

The patterns find e-mail addresses, IP addresses, card and phone numbers: the protected
entities. A term of a text that holds an entity, wherever it stands in it, discloses the
entity if the corpus says so: with n_e distinct texts that hold entity e, n_t that hold term
t, n_te that hold both, of N in all, the pointwise mutual information log(p(e | t) N / n_e) is
compared with the information content log(N / n_e) of the entity itself. p(e | t) is smoothed
by one text that follows the prior, (n_te + n_e / N) / (n_t + 1), so that entities seen in one
text or two are judged like all others, on as much evidence as there is. A term that gives
away more than the share ``ALPHA`` of the content is generalised (digits) or removed (words)
in the texts that hold the entity. Texts without it stay: they link the term to nothing.

Entities that stand in exactly the same texts have the same counts and are judged as one.
All of it is DataFrame and SQL functions.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.llm._common import stored

ALPHA = 0.8
#: Texts are taken apart into words by pieces of so many characters and the word they end in.
PIECE = 512

#: In the order of kinds. Possessive loops keep matching linear without changing a match; a match starts
#: where its run of characters starts, or where the one before ended.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term"]
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
_WORD = r"[\p{L}\p{N}]{3,}"


def _located(text: Column, pattern: str) -> Column:
    """start, end and value of each match, in code points: pieces between matches and matches in turn add up to places."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    pairs = F.zip_with(hits, gaps, lambda h, g: F.struct(h.alias("h"), g.alias("g")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["g"]
        b = a + F.length(x["h"])
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(F.struct(a.alias("start"), b.alias("end"), x["h"].alias("value")))).alias("out"))

    return F.aggregate(F.filter(pairs, lambda x: x["h"].isNotNull()), start, step, lambda acc: acc["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right counts double, its digits added."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, F.try_to_number(d, F.lit("9")).cast("int")).otherwise((2 * F.try_to_number(d, F.lit("9")).cast("int") / 10).cast("int") + (2 * F.try_to_number(d, F.lit("9")).cast("int")) % 10))
    return F.aggregate(F.filter(each, lambda d: d.isNotNull()), F.lit(0), lambda s, d: s + d) % 10 == 0


def base_spans(text: Column) -> Column:
    """Spans of the four kinds in a text, by start, then kind."""
    n = lambda v: F.length(_digits(v))
    accept = {
        "email": lambda v: F.lit(True),
        "ip": lambda v: v.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
        "card": lambda v: n(v).between(14, 19) & _luhn(_digits(v)),
        "phone": lambda v: n(v).between(10, 15),
    }
    #: What a text must hold for the pattern to be tried at all.
    hint = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]"), "card": text.rlike(r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){13}"), "phone": text.rlike(r"\+[0-9]")}
    none = F.array().cast(_SPAN)
    def spans(i: int, kind: str) -> Column:
        valid = F.filter(_located(text, PATTERNS[kind]), lambda s: accept[kind](s["value"]))
        return F.transform(valid, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))

    found = [F.when(hint[kind], spans(i, kind)).otherwise(none) for i, kind in enumerate(PATTERNS)]
    return F.array_sort(F.concat(*found))


def detect(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, h, spans, text) of the documents with any base span; h is a hash of the text, so that rows that repeat an id stay apart."""
    x = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(x).alias("h"), x.alias("text"))
    return rows.select("doc_id", "h", base_spans(F.col("text")).alias("spans"), "text").filter(F.size("spans") > 0)


def _occurrences(found: DataFrame) -> DataFrame:
    """(h, term, start, end) of the words outside all base spans. A piece never ends within a word."""
    pieces = F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{PIECE}}}[\p{{L}}\p{{N}}]*+"), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    places = F.aggregate("p", start, lambda acc, x: F.struct((acc["at"] + F.length(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def own(x: Column, at: Column) -> Column:
        spans = F.filter("spans", lambda s: (s["start"] < at + F.length(x)) & (at < s["end"]))
        return F.struct(x.alias("x"), at.alias("at"), spans.alias("spans"))

    one = found.select("h", "spans", pieces.alias("p")).select("h", F.explode(F.zip_with("p", places, own)).alias("p")).select("h", "p.*")
    words = F.transform(_located(F.col("x"), _WORD), lambda w: F.struct((w["start"] + F.col("at")).alias("start"), (w["end"] + F.col("at")).alias("end"), w["value"].alias("value")))
    clear = F.filter(words, lambda w: ~F.exists("spans", lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))
    return one.select("h", F.explode(clear).alias("w")).select("h", F.lower("w.value").alias("term"), F.col("w.start").alias("start"), F.col("w.end").alias("end"))


def _entities(found: DataFrame) -> DataFrame:
    """(h, e, n_e): what stands in each text, with the number of texts that hold it; e is a 128-bit identity of that set of texts."""
    entity = F.concat(F.col("s.kind").cast("string"), F.lit(":"), F.lower("s.value"))
    held = found.select("h", F.explode("spans").alias("s")).select("h", entity.alias("entity")).distinct()
    sets = held.groupBy("entity").agg(F.count("*").alias("n_e"), F.bit_xor(F.xxhash64("h", F.lit(1))).alias("a"), F.bit_xor(F.xxhash64("h", F.lit(2))).alias("b"))
    return held.join(sets, "entity").select("h", F.struct("a", "b", "n_e").alias("e"), "n_e").distinct()


def term_counts(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(term, n_t) and a row with N: distinct texts that hold each term, and all distinct texts."""
    x = F.coalesce(F.col(text), F.lit(""))
    hashes = docs.select(F.xxhash64(x).alias("h"))
    texts = docs.select(F.xxhash64(x).alias("h"), x.alias("x")).dropDuplicates(["h"])
    words = F.array_distinct(F.transform(F.regexp_extract_all("x", F.lit(_WORD), F.lit(0)), lambda w: F.lower(w)))
    n_t = texts.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    return n_t, hashes.distinct().agg(F.count("*").alias("n"))


def disclosing_terms(docs: DataFrame, found: DataFrame, words: DataFrame, text: str = "text", alpha: float = ALPHA) -> DataFrame:
    """(h, term): the terms of each text that give away an entity in it. Counts are of distinct texts, over all documents."""
    n_t, total = term_counts(docs, text)
    entities = stored(_entities(found).crossJoin(total).filter("n_e < n"))  # total is one row
    share = F.pow(F.col("n_e") / F.col("n"), F.lit(1 - alpha))  # of p(e | t), from which a term discloses
    #: Terms too common for any entity of their text, even if all its texts hold them, go first.
    most = entities.groupBy("h").agg(F.max((F.col("n_e") + F.col("n_e") / F.col("n")) / share).alias("most"))
    held = stored(words.select("h", "term").distinct().join(most, "h").join(n_t, "term").filter(F.col("n_t") + 1 <= F.col("most") * (1 + 1e-9)).select("h", "term", "n_t"))
    discloses = lambda n_te: (n_te + F.col("n_e") / F.col("n")) / (F.col("n_t") + 1) >= share
    lone = held.join(entities.filter("n_e = 1").select("h", "n_e", "n"), "h").filter(discloses(F.lit(1))).select("h", "term")
    pairs = held.join(entities.filter("n_e > 1"), "h")
    above = pairs.groupBy("e", "term").agg(F.count("*").alias("n_te"), F.first("n_t").alias("n_t"), F.first("n_e").alias("n_e"), F.first("n").alias("n")).filter(discloses(F.col("n_te")))
    return lone.unionByName(pairs.join(above.select("e", "term"), ["e", "term"]).select("h", "term")).distinct()


def annotate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", alpha: float = ALPHA) -> DataFrame:
    """(doc_id, h, spans): base spans and disclosing terms, by start, then kind, of each distinct (doc_id, h) that has any."""
    detected = stored(detect(docs, text, doc_id).dropDuplicates(["doc_id", "h"]))
    found = detected.select("h", "spans", "text").dropDuplicates(["h"])
    words = stored(_occurrences(found))
    hits = words.join(disclosing_terms(docs, found, words, text, alpha), ["h", "term"]).select("h", F.struct(F.col("start"), F.lit(len(PATTERNS)).alias("kind"), F.col("end"), F.lit(None).cast("string").alias("value")).alias("s"))
    terms = hits.groupBy("h").agg(F.collect_list("s").alias("terms"))
    spans = F.array_sort(F.concat(F.array_distinct("spans"), F.coalesce("terms", F.array().cast(_SPAN))))
    return detected.select("doc_id", "h", "spans").join(terms, "h", "left").select("doc_id", "h", spans.alias("spans"))


def _of(kind: int, span: Column) -> Column:
    return span["kind"] == kind


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _clean(text: Column, spans: Column) -> Column:
    """The text with each span replaced: e-mail, IP, card and phone by their kind, terms of digits by #, words by a mark."""
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in PATTERNS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        word = text.substr(s["start"] + 1, s["end"] - s["start"])
        mark = F.when(s["kind"] < len(PATTERNS), F.element_at(marks, F.least(s["kind"] + 1, F.lit(len(PATTERNS))))).when(word.rlike("^[0-9]+$"), F.lit("#")).otherwise(F.lit("[TERM]"))
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], text.substr(acc["at"] + 1, s["start"] - acc["at"]), mark)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))))


def _joined(docs: DataFrame, columns: list[str], text: str, doc_id: str, alpha: float) -> DataFrame:
    spans = annotate(docs, text, doc_id, alpha)
    x = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*[F.col(c) for c in columns], F.col(doc_id).cast("long").alias("__id"), F.xxhash64(x).alias("__h"))
    spans = spans.withColumnsRenamed({"doc_id": "__id2", "h": "__h2", "spans": "__spans"})
    return rows.join(spans, F.col("__id").eqNullSafe(F.col("__id2")) & (F.col("__h") == F.col("__h2")), "left").withColumn("__spans", F.coalesce("__spans", F.array().cast(_SPAN)))


def sanitise(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", alpha: float = ALPHA) -> DataFrame:
    """All columns of ``docs`` with the text sanitised. Null and empty texts, and texts without personal data, stay as they are; so do rows that repeat."""
    out = _joined(docs, docs.columns, text, doc_id, alpha)
    clean = F.when(F.size("__spans") > 0, _clean(F.col(text), F.col("__spans"))).otherwise(F.col(text))
    return out.select(*[clean.alias(c) if c == text else F.col(c) for c in docs.columns])


def digest(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, the number of spans of each kind, base_sha256 and spans (kind:start:end, comma-joined) of every row."""
    out = _joined(docs, [], text, doc_id, ALPHA)
    base = F.filter("__spans", lambda s: s["kind"] < len(PATTERNS))
    counts = [F.size(F.filter("__spans", partial(_of, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select(F.col("__id").alias("doc_id"), *counts, F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("__spans")).alias("spans"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
