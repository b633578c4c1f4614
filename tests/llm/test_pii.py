import hashlib
import re

import pytest

from loamgraph.llm import pii

from .data import frame, rows

RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x, d: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x, d: all(int(p) <= 255 for p in x.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda x, d: 14 <= len(d) <= 19 and sum(n if i % 2 == 0 else n * 2 // 10 + n * 2 % 10 for i, n in enumerate(map(int, reversed(d)))) % 10 == 0),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x, d: 10 <= len(d) <= 15),
]


def base(text):
    found = [(m.start(), k, m.end(), name) for k, (name, pattern, valid) in enumerate(RULES) for m in re.finditer(pattern, text or "") if valid(m.group(), re.sub("[^0-9]", "", m.group()))]
    return [(name, a, b) for a, _, b, name in sorted(found)]


def test_base_spans_are_those_of_the_patterns(spark):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.digest(frame(spark)).collect())
    want = []
    for r in rows():
        spans = base(r[1])
        n = [sum(s[0] == k for s in spans) for k, _, _ in RULES]
        want.append((r[0] if r[0] is not None else -1, *n, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()))
    assert got == sorted(want)


def test_terms_that_give_an_entity_away_are_removed(spark):
    got = {r.doc_id: r for r in pii.sanitise(frame(spark)).collect()}
    original = {r[0]: r for r in rows()}
    private = [r[0] for r in rows() if r[1] and "Zorblat handles" in r[1]][0]
    assert "mail.example.org" not in got[private].text and "orblat" not in got[private].text
    assert got[private].text.startswith("[TERM] handles [EMAIL]")
    plain = [i for i, r in original.items() if not base(r[1])]
    assert all(got[i].text == original[i][1] for i in plain)
    assert pii.sanitise(frame(spark)).count() == len(rows())


@pytest.mark.parametrize("call", [pii.digest, pii.sanitise])
def test_empty_table(spark, call):
    assert call(frame(spark, True)).collect() == []


def sanitised(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id: r.text for r in pii.sanitise(docs).collect()}


FILLER = [f"plain words of text number{i} and nothing more" for i in range(300)]


def test_terms_of_an_entity_in_one_text_are_removed_however_far(spark):
    far = "Quexley " + "plain words and more " * 60 + "İstanbulfoo 81234 wrote a@b.org"
    got = sanitised(spark, [far, *FILLER])
    assert got[0] == "[TERM] " + "plain words and more " * 60 + "[TERM] # [TERM] [EMAIL]"
    assert [got[i + 1] for i in range(len(FILLER))] == FILLER


def test_copies_of_a_text_do_not_hide_its_terms(spark):
    shared = [f"quexley plain words a@b.org number{i}" for i in range(3)]
    got = sanitised(spark, [*shared, *shared[:1] * 1000, *FILLER])
    assert all("quexley" not in got[i] for i in range(1003))
    assert "plain words" in got[0]
