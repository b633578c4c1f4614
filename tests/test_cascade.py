"""Names resolved in their order, against a plain run that takes one name after the other."""

import random

import pytest
from pyspark.sql import functions as F

from loamgraph.functions import fuzzy as Z
from loamgraph.operators import cascade as K
from loamgraph.operators import entities


def names(seed):
    r = random.Random(seed)
    first, last = ["John", "Jon", "Johnny", "William", "Wm.", "Catherine", "Katherine", "J.", "Ann", "Anna"], ["Smith", "Smyth", "Smithson", "O'Neil", "O Neil", "Berg", "Bergh"]
    out = []
    for _ in range(140):
        n = f"{r.choice(first)} {r.choice(['', '', 'Q. ', 'Lee '])}{r.choice(last)}"
        if r.random() < 0.3:
            i = r.randrange(len(n))
            n = n[:i] + r.choice("aeiou ") + n[i + 1 :]
        out.append(r.choice([n, n.upper(), n, " ".join(reversed(n.split()))]))
    return out + ["Al", "Bob", "bob", "Rob", "Bobb", "Smith", "Ann"]


COMPANIES = ["Acme Tools Inc", "ACME TOOLS", "Tools Acme LLC", "Acme Tool Inc", "Green Bank", "Bank of Green", "Green Banks", "Blue Trust", "Blue Trusts", "Bleu Trust", "Acme", "Tools", "Globex Corporation", "Globex Corp"]


def one_after_the_other(spark, batch, known, person):
    """{name: (id, how)}; the safeguards are asked for all pairs at once, as they are columns."""
    every = sorted({n for _, n in batch} | {n for _, n, a in known for n in [n, *a]})
    pairs = spark.createDataFrame([(a, b, round(Z.match_score(a, b, person), 6)) for a in every for b in every], "a string, b string, s double")
    score = {(a, b): round(Z.match_score(a, b, person), 6) for a in every for b in every}
    able = {(r.a, r.b) for r in pairs.filter("s > 0.5").select("a", "b", entities.may_merge(F.col("a"), F.col("b"), F.lit(1.0), person).alias("ok"), (entities.may_merge(F.col("a"), F.col("b"), F.lit(0.94), person)).alias("low")).filter("ok").collect()}
    short = {(r.a, r.b) for r in pairs.select("a", "b", entities.may_merge(F.col("a"), F.col("b"), F.lit(0.94), person).alias("ok")).filter("NOT ok").collect()}
    held = [(i, n, [n, *a]) for i, n, a in sorted(known)]  # id, main name, spellings
    out = {}
    for _, n in sorted(batch):
        if len(n) < 3 or n in out:
            continue
        same = [e for e in held if n.lower() in [x.lower() for x in e[2]]]
        if same:
            out[n] = (same[0][0], "exact" if same[0][0][:4] != "new:" or same[0][1].lower() == n.lower() else "alike")
            continue
        best = max(((score[n, x], -k, -j) for k, e in enumerate(held) for j, x in enumerate(e[2])), default=(0, 0, 0))
        # of equal scores: known entities in order, then new names in the order they came, whatever entity they are of
        if best[0] >= K.LEAST:
            ties = [(order_of(x, e, batch), e) for e in held for x in e[2] if score[n, x] == best[0]]
            entity = min(ties, key=lambda t: t[0])[1]
            s = best[0]
            if (n, entity[1]) in able and (s >= 0.95 or (n, entity[1]) not in short):
                entity[2].append(n)
                out[n] = (entity[0], "alike")
                continue
        held.append((f"new:{n}", n, [n]))
        out[n] = (f"new:{n}", "created")
    return out


def order_of(x, entity, batch):
    at = [s for s, n in batch if n.lower() == x.lower()]
    known = entity[0][:4] != "new:" and not at
    return (0, entity[0], entity[2].index(x)) if known else (1, "", min(at))


@pytest.mark.parametrize("seed", [1, 2])
def test_persons_resolve_as_one_after_the_other(spark, seed):
    all_names = names(seed)
    known = [("C-1", "John Smith", ["Johnny Q. Smith"]), ("C-2", "Catherine Berg", [])]
    taken = {x.lower() for _, n, a in known for x in [n, *a]}
    batch = [(i, n) for i, n in enumerate(all_names)]
    want = one_after_the_other(spark, batch, known, True)
    random.Random(3).shuffle(batch)
    frame = spark.createDataFrame(batch + [(999, None)], "seq long, name string").repartition(3)
    got = {r.name: (r.id, r.how) for r in K.resolved(frame, spark.createDataFrame(known, "id string, name string, aliases array<string>"), True).collect()}
    assert taken and set(got) == set(want)
    assert {n: v[0] for n, v in got.items()} == {n: v[0] for n, v in want.items()}
    assert {h for _, h in got.values()} == {"exact", "alike", "created"}


def test_companies_take_the_best_of_all_names(spark):
    batch = list(enumerate(COMPANIES))
    known = [("S-1", "Acme Tools Limited", ["ATL Tools"]), ("S-2", "Green Banking", [])]
    want = one_after_the_other(spark, batch, known, False)
    got = {r.name: r.id for r in K.resolved(spark.createDataFrame(batch, "seq long, name string"), spark.createDataFrame(known, "id string, name string, aliases array<string>"), False).collect()}
    assert got == {n: v[0] for n, v in want.items()}


@pytest.mark.parametrize("person", [True, False])
def test_no_similar_pair_is_lost(spark, person):
    every = sorted({n for n in names(5) + COMPANIES if len(n) >= 3})
    want = {(a, b) for a in every for b in every if a != b and round(Z.match_score(a, b, person), 6) >= K.LEAST}
    got = {(r.a, r.b) for r in K.similar(spark.createDataFrame([(n,) for n in every], "name string"), person).collect()}
    assert got == want and len(want) > 100


@pytest.mark.parametrize("least", [0.7, 0.8, 0.82, 0.85, 0.95])
def test_alike_gives_the_pairs_that_are_and_no_others(spark, least):
    r = random.Random(4)
    every = sorted({"".join(r.choice("abé") for _ in range(r.randint(3, 13))) for _ in range(220)} | {n.lower() for n in names(6) if len(n) >= 3})
    want = {(a, b) for a in every for b in every if a < b and Z.ratio(a, b) >= 100 * least - 1e-9}
    got = [(x.a, x.b) for x in entities.alike(spark.createDataFrame([(x,) for x in every], "s string"), least).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_joint_names_titles_and_organisations(spark):
    empty = spark.createDataFrame([], "id string, name string, aliases array<string>")
    batch = spark.createDataFrame([(1, "Dr. John & Mary Smithfield"), (2, "mary smithfield"), (3, "Acme Bank"), (4, "Acme Banks"), (5, None), (6, "Al")], "seq long, name string")
    got = {(r.seq, r.person): (r.id, r.how, r.kind) for r in K.resolve_people(batch, empty, empty).collect()}
    assert got == {
        (1, "John Smithfield"): ("new:John Smithfield", "created", "person"),
        (1, "Mary Smithfield"): ("new:Mary Smithfield", "created", "person"),
        (2, "mary smithfield"): ("new:Mary Smithfield", "exact", "person"),
        (3, "Acme Bank"): ("new:Acme Bank", "created", "organisation"),
        (4, "Acme Banks"): ("new:Acme Bank", "alike", "organisation"),
    }
    assert K.resolve_people(batch.limit(0), empty, empty).collect() == []


def test_pairs_come_from_tiles_not_from_shared_pieces(spark):
    every = spark.createDataFrame([(f"{a}{b} {c}",) for a in ("jo", "el", "an") for b in ("sama", "luto", "kean") for c in ("berleyberez", "berleybrez", "tanson")], "s string")
    plan = entities.alike(every, 0.85)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "levenshtein" not in plan and "Broadcast" not in plan


def test_common_of_many_equals_common():
    r = random.Random(8)
    import numpy as np

    for m, n in ((1, 4), (9, 9), (63, 70), (5, 12)):
        x, y = (["".join(r.choice("abcé日") for _ in range(size)) for _ in range(40)] for size in (m, n))
        i, j = (v.ravel() for v in np.indices((40, 40)))
        assert Z.common_of(Z.codes(x), Z.codes(y), i, j).tolist() == [Z.common(x[p], y[q]) for p, q in zip(i, j)]
    x = Z.Strings(["ab" * 40 + c for c in "abcdefg"])
    assert sorted(zip(*map(list, Z.alike_pairs(x, x, 0.98)))) == [(p, q) for p in range(7) for q in range(p + 1, 7)]
