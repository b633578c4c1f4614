"""Duplicate entities: candidates by similar names, safeguards, scores for review, decisions and merged groups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamgraph.functions import fuzzy as Z
from loamgraph.functions import names as N
from loamgraph.session import reachable, settled
from loamgraph.sources.bindings import nodes, table

LEAST = 82
#: Parts of a group that pairs within it are made in.
BLOCKS = 128
#: Strings and characters of a tile, and parts that tiles are dealt to.
TILE, CHARS, PARTS = 1024, 1 << 20, 48
# Labels by the risk of a wrong merge.
HIGH_RISK = ["Person", "Address", "MedicalResult", "Condition", "Contract", "InsurancePolicy", "FinancialItem", "DateEvent", "Event"]
LOW_RISK = ["Organization", "Product", "System", "DocumentRef", "Location"]
TERMINAL = ["ignore", "split", "merged", "never_merge", "auto_merged"]


def alike(strings: DataFrame, least: float) -> DataFrame:
    """(a, b) of (s) distinct strings of 3 characters or more whose ratio is ``least`` (0.7 to 1) or more; a < b. No such pair is lost.

    Strings lie in tiles of one length; each tile meets those of lengths near enough, see
    fuzzy.alike_pairs(), and only pairs that are alike leave it.
    """
    reachable(strings.sparkSession)
    sized = strings.filter(F.length("s") >= 3).select("s", F.length("s").alias("n"))
    most = F.greatest(F.lit(1.0), F.least(F.lit(float(TILE)), CHARS / F.col("n")))
    parts = sized.groupBy("n").agg(F.count("*").alias("k")).select("n", F.ceil(F.col("k") / most).alias("parts"))
    tiles = sized.join(parts, "n").withColumn("part", F.pmod(F.xxhash64("s"), F.col("parts"))).groupBy("n", "part").agg(F.collect_list("s").alias("all"))
    tiles = settled(tiles.repartition(PARTS))
    longer, shorter = (tiles.select(F.col("n").alias(f"{x}n"), F.col("part").alias(f"{x}part"), F.col("all").alias(f"{x}all")) for x in "xy")
    near = (F.col("yn") >= F.col("xn") * (least / (2 - least)) - 1e-3) & ((F.col("xn") > F.col("yn")) | (F.col("xn") == F.col("yn")) & (F.col("xpart") >= F.col("ypart")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, x = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                xn, xpart, yn, ypart = (batch[c][i].as_py() for c in ("xn", "xpart", "yn", "ypart"))
                if at != (xn, xpart):
                    at, x = (xn, xpart), Z.Strings(batch["xall"][i].as_py())
                y = x if at == (yn, ypart) else Z.Strings(batch["yall"][i].as_py())
                r, c = Z.alike_pairs(x, y, least)
                of_x, of_y = pa.array(x.strings), pa.array(y.strings)
                for k in range(0, len(r), 1 << 16):
                    yield pa.RecordBatch.from_arrays([of_x.take(pa.array(r[k : k + (1 << 16)])), of_y.take(pa.array(c[k : k + (1 << 16)]))], names=["x", "y"])

    found = longer.hint("shuffle_replicate_nl").join(shorter, near).mapInArrow(run, "x string, y string")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def met(named: DataFrame, least: int) -> DataFrame:
    """(label, a, b): the pairs of candidates(), which are scored there."""
    words = F.array_sort(F.filter(F.split("name", r"\s+"), lambda w: w != ""))
    # Read by four joins below: the source is read and its names are made distinct once.
    forms = settled(named.select("label", "name").filter("name IS NOT NULL").distinct().withColumn("s", F.array_join(words, " ")))
    strings = forms.select("s").distinct()
    found = alike(strings, least / 100).unionByName(strings.select(F.col("s").alias("a"), F.col("s").alias("b")))
    left, right = (forms.select("label", F.col("name").alias(x), F.col("s").alias(y)) for x, y in (("x", "a"), ("y", "b")))
    # Found pairs come once, a before b, so only names of equal words come both ways round.
    pairs = found.join(left, "a").join(right, ["label", "b"]).filter("a < b OR x < y").select("label", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return pairs


def candidates(named: DataFrame, least: int = LEAST) -> DataFrame:
    """(label, a, b, score): pairs of distinct names of one label whose sorted words are at least so similar. No pair is lost, see alike(); other than equal ones, names of fewer than three characters are like none."""
    return met(named, least).withColumn("score", F.round(Z.token_sort_ratio(F.col("a"), F.col("b")), 6)).filter(F.col("score") >= least)


def may_merge(a: Column, b: Column, score: Column, person: bool) -> Column:
    """Whether two names of this score may be merged unseen."""
    x, y = N.name(a), N.name(b)
    single = lambda n: F.size(N.parts(n)) == 1
    ok = (F.length(x) >= 4) & (F.length(y) >= 4) & (score >= 0.85) & ((F.least(F.length(x), F.length(y)) > 5) | (score >= 0.95))
    if person:
        several = (F.size(N.parts(a)) >= 2) & (F.size(N.parts(b)) >= 2)
        return ok & (single(a) == single(b)) & (~several | Z.first_names(a, b))
    return ok & (F.size(F.array_intersect(N.distinctive(a), N.distinctive(b))) > 0)


def flagged(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs (label, a, b) of these names (name) that are candidates, with their best score and may_merge(), by the rules of persons for the label Person.

    Each name is looked at once, not in each of its pairs; first names are compared where they count.
    """
    x = F.struct(F.length(N.name(F.col("name"))).alias("length"), F.size(N.parts(F.col("name"))).alias("parts"), N.distinctive(F.col("name")).alias("words"))
    traits = settled(names.select("name").distinct().select("name", x.alias("t")))
    for c in "ab":
        pairs = pairs.join(traits.select(F.col("name").alias(c), F.col("t").alias(f"t{c}")), c)
    person, best, p, q = F.col("label") == "Person", F.col("best"), F.col("ta.parts"), F.col("tb.parts")
    least = F.least("ta.length", "tb.length")
    fits = (least >= 4) & (best >= 0.85) & ((least > 5) | (best >= 0.95))
    several = person & fits & (p >= 2) & (q >= 2)
    first = Z.first_names(F.when(several, F.col("a")), F.when(several, F.col("b")))
    merge = fits & F.when(person, ((p == 1) == (q == 1)) & (~several | first)).otherwise(F.size(F.array_intersect("ta.words", "tb.words")) > 0)
    scored = pairs.withColumn("s", Z.scores(F.col("a"), F.col("b"), person)).filter(F.round("s.words", 6) >= LEAST)
    return scored.withColumn("best", F.round("s.best", 6)).select("label", "a", "b", "best", merge.alias("merge"))


def thinned(links: DataFrame) -> DataFrame:
    """Links (a, b) that connect what these do, as few as each task needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[str, str] = {}

        def root(x: str) -> str:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for batch in batches:
            for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist()):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
        names = list(parent)
        for k in range(0, len(names), 1 << 14):
            some = names[k : k + (1 << 14)]
            yield pa.RecordBatch.from_arrays([pa.array(map(root, some), pa.string()), pa.array(some, pa.string())], names=["a", "b"])

    return links.select("a", "b").mapInArrow(run, "a string, b string").filter("a <> b")


def review_score(label: Column, a: Column, b: Column, score: Column, shared_ids: Column) -> Column:
    """(score, risk, recommendation) of a candidate pair with a name similarity of 0 to 100."""
    risk = F.when(label.isin(HIGH_RISK), "high").when(label.isin(LOW_RISK), "low").otherwise("medium")
    exact = (N.steward_name(a) == N.steward_name(b)) & (N.steward_name(a) != "")
    s = 0.25 + 0.35 * score / 100 + F.when(exact, 0.22).otherwise(0.0) + F.when(label != "", 0.08).otherwise(0.0) + F.when(shared_ids, 0.28).otherwise(0.0) - F.when(risk == "high", 0.12).otherwise(0.0)
    s = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)), 6)
    advice = F.when((s >= 0.86) & (risk == "low"), "merge").when((s <= 0.5) | ((risk == "high") & ~shared_ids & ~exact), "split").otherwise("review")
    return F.struct(F.round(s + 1e-9, 3).alias("score"), risk.alias("risk"), advice.alias("recommendation"))


def undecided(pairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pairs (a, b) without a decision that ends their review, whichever way round it was written."""
    done = decisions.filter(F.col("decision").isin(TERMINAL)).select(F.least("left", "right").alias("a"), F.greatest("left", "right").alias("b")).distinct()
    return pairs.join(done, ["a", "b"], "left_anti")


def groups(links: DataFrame) -> DataFrame:
    """(name, keep): each linked name with the first of all that links reach; a few rounds of joins, as chains of names are short."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().persist()
    state = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("keep"))
    while True:
        seen = both.join(state.select(F.col("a").alias("b"), "keep"), "b").groupBy("a").agg(F.min("keep").alias("near"))
        new = state.join(seen, "a").select("a", F.least("keep", "near").alias("keep")).persist()
        changed = not new.join(state.withColumnRenamed("keep", "old"), "a").filter("keep <> old").isEmpty()
        state = new
        if not changed:
            return state.select(F.col("a").alias("name"), "keep")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).filter("label <> 'Document'").select("label", "name")


def fuzzy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(_names(spark, sf_dir))


def auto_merge_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with their best score and whether they may be merged unseen."""
    names = settled(_names(spark, sf_dir).distinct())
    return flagged(met(names, LEAST), names)


def resolve_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(settled(thinned(auto_merge_flags(spark, sf_dir).filter("merge"))))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part with the next one as a pair under review: names, label, a score and whether they share an identifier, by their numbers."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    other = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.concat(F.when(F.col("p_partkey") % 3 == 0, F.lit("The ")).otherwise(F.lit("")), "p_name").alias("other"))
    label = F.element_at(F.array(*map(F.lit, ["Person", "Product", "Topic", "Contract"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    return part.join(other, "p_partkey").select("p_partkey", label.alias("label"), "p_name", "other", ((F.col("p_partkey") * 7) % 101).alias("score"), (F.col("p_partkey") % 5 == 0).alias("shared"))


def steward_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = review_score(F.col("label"), F.col("p_name"), F.col("other"), F.col("score"), F.col("shared"))
    return _pairs(spark, sf_dir).select("p_partkey", s.alias("s")).select("p_partkey", "s.*")


def steward_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs each recommendation suggests."""
    return steward_score(spark, sf_dir).groupBy(F.concat(F.lit("suggest_"), "recommendation").alias("decision")).agg(F.count("*").alias("pairs"))


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions at hand: the pairs of suppliers that follow one another, some of them written the other way round."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    decision = F.element_at(F.array(*map(F.lit, ["ignore", "suggest_merge", "split"])), (F.col("s_suppkey") % 3 + 1).cast("int"))
    a, b = F.col("s_suppkey"), F.col("s_suppkey") + 1
    return s.select(F.when(a % 2 == 0, a).otherwise(b).alias("left"), F.when(a % 2 == 0, b).otherwise(a).alias("right"), decision.alias("decision"))


def pairs_within(rows: DataFrame, key: str, group: str) -> DataFrame:
    """(a, b), a < b, of all keys that share a group, each pair once; a key's repeated rows count as one.

    As many pairs as there are come out, so they are made where they are needed: keys meet in BLOCKS
    parts of a group, and a pair of several groups only in the first of them, so no pair is held.
    """
    of = rows.filter(F.col(group).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.collect_set(group).alias("all")).withColumn("g", F.explode("all"))
    left = of.select(F.col("k").alias("a"), F.col("all").alias("x"), "g", F.pmod(F.xxhash64("k"), F.lit(BLOCKS)).alias("block")).repartition(BLOCKS, "g", "block")
    right = of.select(F.col("k").alias("b"), F.col("all").alias("y"), "g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BLOCKS - 1).cast("long"))).alias("block")).repartition(BLOCKS, "g", "block")
    return left.join(right, ["g", "block"]).filter((F.col("a") < F.col("b")) & (F.col("g") == F.array_min(F.array_intersect("x", "y")))).select("a", "b")


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of one nation that follow one another closely, without those decided on."""
    s = table(spark, sf_dir, "supplier")
    near = pairs_within(s, "s_suppkey", "s_nationkey")
    of = s.filter("s_suppkey IS NOT NULL").groupBy("s_suppkey").agg(F.collect_set("s_nationkey").alias("nations"))
    next_one = of.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("nations").alias("others"))
    follow = of.join(next_one, "s_suppkey").filter(F.size(F.array_intersect("nations", "others")) == 0).select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1).alias("b"))
    return undecided(near.unionByName(follow), _decisions(spark, sf_dir))


QUERIES = {f.__name__: f for f in (fuzzy_candidates, auto_merge_flags, resolve_components, steward_score, steward_report, review_queue)}
_STEWARD = rf"""WITH p AS (SELECT p.p_partkey, ['Person', 'Product', 'Topic', 'Contract'][p.p_partkey % 4 + 1] AS label, p.p_name, CASE WHEN n.p_partkey % 3 = 0 THEN 'The ' ELSE '' END || n.p_name AS other, (p.p_partkey * 7) % 101 AS score, p.p_partkey % 5 = 0 AS shared FROM part p JOIN part n ON n.p_partkey = p.p_partkey + 1),
x AS (SELECT *, CASE label WHEN 'Person' THEN 'high' WHEN 'Contract' THEN 'high' WHEN 'Product' THEN 'low' ELSE 'medium' END AS risk, trim(regexp_replace(regexp_replace(lower(p_name), '{N.STEWARD_SUFFIXES}', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) = trim(regexp_replace(regexp_replace(lower(other), '{N.STEWARD_SUFFIXES}', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS exact FROM p),
y AS (SELECT *, round(greatest(0, least(1, 0.25::DOUBLE + 0.35::DOUBLE * score / 100 + CASE WHEN exact THEN 0.22::DOUBLE ELSE 0 END + 0.08::DOUBLE + CASE WHEN shared THEN 0.28::DOUBLE ELSE 0 END - CASE WHEN risk = 'high' THEN 0.12::DOUBLE ELSE 0 END)), 6) AS s FROM x),
r AS (SELECT p_partkey, round(s + 1e-9, 3) AS score, risk, CASE WHEN s >= 0.86 AND risk = 'low' THEN 'merge' WHEN s <= 0.5 OR (risk = 'high' AND NOT shared AND NOT exact) THEN 'split' ELSE 'review' END AS recommendation FROM y)
"""
ORACLE_SQL = {
    "steward_score": _STEWARD + "SELECT * FROM r",
    "steward_report": _STEWARD + "SELECT 'suggest_' || recommendation AS decision, count(*) AS pairs FROM r GROUP BY 1",
    "review_queue": "SELECT a, b FROM (SELECT x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey < y.s_suppkey UNION SELECT x.s_suppkey, y.s_suppkey FROM supplier x JOIN supplier y ON y.s_suppkey = x.s_suppkey + 1) WHERE NOT (b = a + 1 AND a % 3 IN (0, 2))",
}
