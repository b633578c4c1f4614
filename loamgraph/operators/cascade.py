"""Names of a batch resolved in their order against known entities and against one another: the same, most alike and safe to merge, or new.

Resolving one name after the other makes each name a candidate for those behind it, as an
entity's own name or as one of its aliases. Whichever it becomes, the name a later one is most
alike to is the same, so it is found for all names at once: it is each name's parent. What is
left of the order is whether the safeguards let a name join its parent's entity, which rests on
that entity's own name: names are decided once their parents are, a generation at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamgraph.functions import fuzzy as Z
from loamgraph.functions import names as N
from loamgraph.operators import entities
from loamgraph.session import settled
from loamgraph.sources.bindings import table

#: Score from which names may merge.
LEAST = 0.85
#: Ratio of words that count as alike parts of a name.
ALIKE = 0.8
# Words that mark an organisation among persons.
ORGANISATIONS = ["llc", "inc", "corp", "ltd", "company", "co.", "solutions", "services", "association", "foundation", "bank", "mortgage", "insurance", "financial", "trust", "group", "partners"]


def _others_match(x: Column, y: Column, a: Column, b: Column) -> Column:
    """Whether names of these words, of which a and b match, may match by their parts: then no word of theirs is left, or two others match as well.

    The match of parts reaches LEAST only if the mean worth of the shorter name's words does, so
    of two words or more at least two match. Names that repeat a word are not judged.
    """
    begin = lambda p, q: (F.substring(p, 1, 1) == F.substring(q, 1, 1)) & (_brief(p) | _brief(q))
    close = lambda p, q: F.levenshtein(p, q) <= (1 - ALIKE) * (F.length(p) + F.length(q)) + 1e-3
    more = F.exists(F.array_except(x, F.array(a)), lambda p: F.exists(F.array_except(y, F.array(b)), lambda q: (p == q) | begin(p, q) | close(p, q)))
    repeats = (F.size(x) > F.size(F.array_distinct(x))) | (F.size(y) > F.size(F.array_distinct(y)))
    return repeats | (F.size(x) == 1) & (F.size(y) == 1) | more


def _may_match() -> Column:
    """False for names x and y whose one other word each cannot match, by the letters that only one of the two has; see others()."""
    x, y = F.col("x.rest"), F.col("y.rest")
    return F.coalesce(F.bit_count(x["letters"].bitwiseXOR(y["letters"])) <= (1 - ALIKE) * (x["n"] + y["n"]) + 1e-3, F.lit(True))


def others(words: DataFrame) -> DataFrame:
    """Words (name, parts, s) of names with rest (letters, n), a mask of the letters and the length of the one other word; null if there are more, or if it is brief."""
    rest = F.element_at(F.array_except("parts", F.array("s")), 1)
    found = words.withColumn("other", F.when((F.size("parts") == 2) & (F.size(F.array_distinct("parts")) == 2), rest))
    letters = F.expr("aggregate(split(other, ''), 0L, (m, c) -> m | shiftleft(1L, pmod(hash(c), 64)))")
    return found.withColumn("rest", F.when(F.col("other").isNotNull() & ~_brief(F.col("other")), F.struct(letters.alias("letters"), F.length("other").alias("n")))).drop("other")


def _brief(word: Column) -> Column:
    """Whether a word may stand for a longer one, or a longer one for it."""
    return (F.length(word) == 1) | word.isin([*Z.ABBREVIATIONS, *Z.ABBREVIATIONS.values()])


def similar(names: DataFrame, person: bool) -> DataFrame:
    """(a, b, score) of all pairs of (name) distinct names whose match reaches LEAST, both ways round.

    By the three measures (see fuzzy.match_score): whole names and sorted words are alike, or
    parts are: then a word is equal, or alike, to one of the other name.
    """
    plain = F.lower(N.name(F.col("name")))
    words = F.array_sort(F.filter(F.split(plain, " "), lambda w: w != ""))
    forms = names.select("name", plain.alias("whole"), F.array_join(words, " ").alias("sorted"), F.array_distinct(words).alias("words"), words.alias("parts"), F.array_join(F.array_distinct(words), " ").alias("set"))
    forms = settled(forms)
    strings = forms.select("name", F.explode(F.array_distinct(F.array("whole", "sorted", "set"))).alias("s")).distinct()
    pairs = entities.alike(strings.select("s").distinct(), LEAST)
    equal = strings.select("s").distinct().select(F.col("s").alias("a"), F.col("s").alias("b"))
    by = lambda p, of: p.join(of.select(F.col("s").alias("a"), F.col("name").alias("x")), "a").join(of.select(F.col("s").alias("b"), F.col("name").alias("y")), "b").select("x", "y")
    of_words = forms.select("name", F.explode("words").alias("s"), "parts", F.size("words").alias("n"))
    meet = lambda left, right, on: left.withColumnRenamed("name", "x").join(right.withColumnRenamed("name", "y"), on).select("x", "y")
    alike_words = settled(entities.alike(of_words.select("s").distinct(), ALIKE).repartition(entities.PARTS))
    if person:
        # Two parts of names of several words match: an equal word and one that begins alike, or words are alike and others match too.
        single, several = of_words.filter("n = 1").select("name", "s"), forms.filter(F.size("words") > 1).select("name", "parts", "words", F.explode("words").alias("s"))
        match = lambda df, a, b: df.filter(_may_match()).filter(_others_match(F.col("x.parts"), F.col("y.parts"), a, b)).select(F.col("x.name").alias("x"), F.col("y.name").alias("y"))
        beside = others(several).withColumn("letter", F.explode(F.array_distinct(F.transform(F.array_except("words", F.array("s")), lambda w: F.substring(w, 1, 1)))))
        row = lambda df, x, *on: df.select(F.struct("name", "parts", "rest").alias(x), *on)
        both = row(beside, "x", "s", "letter").join(row(beside, "y", "s", "letter"), ["s", "letter"]).filter("x.name < y.name")
        same = meet(single, of_words.select("name", "s"), "s").unionByName(match(both, F.col("s"), F.col("s")))
        held = others(of_words.select("name", "parts", "s"))
        by_words = alike_words.join(row(held, "x", F.col("s").alias("a")), "a").join(row(held, "y", F.col("s").alias("b")), "b")
        by_words = match(by_words, F.col("a"), F.col("b"))
    else:
        same = meet(of_words.select("name", "s"), of_words.select("name", "s"), "s")
        by_words = by(alike_words, of_words)
    found = by(pairs.unionByName(equal), strings).unionByName(same).unionByName(by_words)
    once = found.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    scored = once.withColumn("score", F.round(Z.match(F.col("a"), F.col("b"), person), 6)).filter(F.col("score") >= LEAST)
    scored = settled(scored)
    return scored.unionByName(scored.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))


def resolved(batch: DataFrame, known: DataFrame, person: bool) -> DataFrame:
    """(name, id, how, score) for each distinct name of a batch (seq, name), taken by their first seq.

    known: id, name, aliases. ``exact``: the name or alias of an entity, whatever its case, of
    several the first; ``alike``: merged with the entity whose name or alias is most alike (of
    several the first: known ones by id, own names before aliases, then new ones in order), as
    the safeguards allow; else ``created``, with an id of "new:" and the name. Names that differ
    by case only are one. Null names and those of fewer than three characters are left out.
    """
    key = F.lower("name")
    old = known.select("id", F.col("name").alias("main"), F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("at", "name")).filter(F.length("name") >= 3)
    old = old.groupBy(key.alias("key")).agg(F.min(F.struct("id", "at", "name", "main")).alias("m")).select("key", "m.*")
    new = batch.filter(F.length("name") >= 3).groupBy(key.alias("key")).agg(F.min(F.struct("seq", "name")).alias("m")).select("key", "m.*")
    both = old.select("key", "name", "id", "main", F.struct(F.lit(0).alias("new"), F.col("id").alias("id"), F.col("at").cast("long").alias("at")).alias("place"))
    fresh = new.join(old.select("key"), "key", "left_anti")
    both = settled(both.unionByName(fresh.select("key", "name", F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("main"), F.struct(F.lit(1).alias("new"), F.lit("").alias("id"), F.col("seq").cast("long").alias("at")).alias("place"))))
    pairs = similar(both.select("name").distinct(), person)
    place = both.select("name", "place")
    before = pairs.join(place.withColumnsRenamed({"name": "a", "place": "pa"}), "a").join(place.withColumnsRenamed({"name": "b", "place": "pb"}), "b").filter("pa.new = 1 AND pb < pa")
    parents = before.groupBy(F.col("a").alias("name")).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("pb"), F.col("b"))).alias("m")).select("name", F.col("m.b").alias("parent"), (-F.col("m.s")).alias("score"))
    children = settled(fresh.select("name").join(parents, "name", "left"))
    created = lambda df: df.select("name", F.concat(F.lit("new:"), "name").alias("id"), F.col("name").alias("main"), F.lit("created").alias("how"), F.lit(None).cast("double").alias("score"))
    frontier = settled(created(children.filter("parent IS NULL")).unionByName(both.filter("id IS NOT NULL").select("name", "id", "main", F.lit("exact").alias("how"), F.lit(None).cast("double").alias("score"))))
    done = [frontier]
    waiting = children.filter("parent IS NOT NULL")
    while True:
        ready = waiting.join(frontier.select(F.col("name").alias("parent"), F.col("id").alias("pid"), F.col("main").alias("pmain")), "parent")
        ready = ready.withColumn("ok", entities.may_merge(F.col("name"), F.col("pmain"), F.col("score"), person))
        ready = settled(ready)
        if ready.isEmpty():
            break
        frontier = ready.filter("ok").select("name", F.col("pid").alias("id"), F.col("pmain").alias("main"), F.lit("alike").alias("how"), "score").unionByName(created(ready.filter("NOT ok")))
        done.append(frontier)
    decided = done[0]
    for part in done[1:]:
        decided = decided.unionByName(part)
    names = batch.filter(F.length("name") >= 3).select("name", key.alias("key")).distinct()
    first = both.select("key", F.col("name").alias("first"))
    out = names.join(first, "key").join(decided.withColumnRenamed("name", "first"), "first")
    how = F.when((F.col("how") == "created") & (F.col("name") != F.col("first")), "exact").otherwise(F.col("how"))
    return out.select("name", "id", how.alias("how"), "score")


def is_organisation(name: Column) -> Column:
    """Whether a person's name holds a word, or the beginning of one, that marks an organisation."""
    padded = F.concat(F.lit(" "), F.lower(name), F.lit(" "))
    out = F.lit(False)
    for word in ORGANISATIONS:
        out = out | F.contains(padded, F.lit(f" {word}"))
    return out


def resolve_people(batch: DataFrame, persons: DataFrame, organisations: DataFrame) -> DataFrame:
    """(seq, name, person, id, how, score, kind): each person that a name of the batch (seq, name) holds, resolved in order of seq.

    Titles go, joint names are taken apart, and what names an organisation is resolved among
    organisations (kind). Names without three characters are left out; null and repeated seqs are
    rows like any other.
    """
    # One step after the other, as each reads what the one before made many times.
    clean = settled(batch.select("seq", "name", N.person_name(F.col("name")).alias("clean"))).filter(F.length("clean") >= 3)
    apart = settled(clean.select("seq", "name", N.joint(F.col("clean")).alias("people"))).select("seq", "name", F.posexplode("people").alias("nth", "person"))
    each = settled(apart.withColumn("person", N.name(F.trim("person")))).filter(F.length("person") >= 3).withColumn("organisation", is_organisation(F.col("person")))
    order = (F.col("seq") * 8 + F.col("nth")).alias("seq")
    out = None
    for organisation, known in ((False, persons), (True, organisations)):
        mine = each.filter(F.col("organisation") == organisation)
        mine = settled(mine.withColumn("clean", N.name(N.org_name(F.col("person"))) if organisation else F.col("person")))
        found = resolved(mine.select(order, F.col("clean").alias("name")), known, not organisation)
        rows = mine.join(found.withColumnRenamed("name", "clean"), "clean").select("seq", "name", "person", "id", "how", "score", F.lit("organisation" if organisation else "person").alias("kind"))
        out = rows if out is None else out.unionByName(rows)
    return out


def aliases(found: DataFrame) -> DataFrame:
    """(id, alias) that resolved names (name, id) add to entities: all spellings but the one an entity is created with."""
    return found.filter(F.concat(F.lit("new:"), "name") != F.col("id")).select("id", F.col("name").alias("alias")).distinct()


def resolve_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients of other sources, in the order of their numbers, against those of the crm."""
    clients = table(spark, sf_dir, "clients").filter("name IS NOT NULL")
    known = clients.filter("source = 'crm'").groupBy("name").agg(F.min("client_id").alias("id")).select(F.concat(F.lit("C-"), F.lpad(F.col("id").cast("string"), 12, "0")).alias("id"), "name", F.array().cast("array<string>").alias("aliases"))
    vendors = table(spark, sf_dir, "vendors").filter("name IS NOT NULL").select(F.concat(F.lit("V-"), F.lpad(F.col("vendor_id").cast("string"), 12, "0")).alias("id"), "name", F.array().cast("array<string>").alias("aliases"))
    batch = clients.filter("source IS NULL OR source <> 'crm'").select(F.col("client_id").alias("seq"), "name")
    return resolve_people(batch, known, vendors)


QUERIES = {"resolve_persons": resolve_persons}
ORACLE_SQL: dict[str, str] = {}
