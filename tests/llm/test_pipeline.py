"""Each stage of the corpus pipeline on what its predecessor kept, against brute force."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline as P
from loamgraph.llm import language, repeats
from loamgraph.llm._common import stored

from .test_copies import prose, removed, sets
from .test_pii import base
from .test_tokens import library

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def data():
    r = random.Random(12)
    passage = prose(r, 55)
    texts = [prose(r, r.choice([4, 40, 120])) for _ in range(30)]
    texts += [f"{prose(r, 30)} {passage} {prose(r, 30)}" for _ in range(4)]
    near = prose(r, 150)
    texts += [near, near + " tail", near.replace("w", "W", 3), near]
    texts += [f"quexley wrote {prose(r, 8)} a.b{i}@mail.example.org" for i in range(3)]
    texts += [None, "", " \t", "12 34 !", "日本 x", passage]
    rows = [(i, x, ["en", "fr", None][i % 3], "s", None) for i, x in enumerate(texts)]
    return [*rows, rows[2], (None, "w1 of no id " + prose(r, 20), None, None, 3)]


@pytest.fixture(scope="module")
def steps(spark):
    out = [stored(spark.createDataFrame(data(), SCHEMA).repartition(3))]
    for _, stage in P.STAGES:
        out.append(stored(stage(spark, out[-1], "")))
    return [sorted(x.collect(), key=str) for x in out]


def test_language_rejects_texts_without_a_letter(steps):
    has = lambda x: any(c.isalpha() for c in x or "")
    assert [(r.doc_id, r.text, r.source) for r in steps[1]] == [(r.doc_id, r.text, r.source) for r in steps[0] if has(r.text)]
    assert {r.lang for r in steps[1]} <= {"en", "fr"}


def test_one_document_of_each_group_stays(steps):
    rows = [r for r in steps[1] if r.doc_id is not None]
    label = {r.doc_id: r.doc_id for r in rows}
    for a in rows:
        for b in rows:
            x, y = sets(a.text, 5), sets(b.text, 5)
            if x and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((label[a.doc_id], label[b.doc_id]))
                label = {k: low if v == high else v for k, v in label.items()}
    assert [(r.doc_id, r.text) for r in steps[2]] == [(r.doc_id, r.text) for r in steps[1] if r.doc_id is None or label[r.doc_id] == r.doc_id]
    assert len(steps[2]) < len(steps[1]) - 2


def test_passages_are_removed(steps):
    kept = removed([r.text for r in steps[2]], repeats.PASSAGE)
    assert sorted((str(r.doc_id), len(r.text.encode())) for r in steps[3]) == sorted((str(r.doc_id), n - gone) for r, (_, n, gone, _, _) in zip(steps[2], kept))
    assert sum(k[2] > 0 for k in kept) >= 4


def test_personal_data_is_replaced_and_other_texts_stay(steps):
    before, after = ({str(r.doc_id): r.text for r in s} for s in steps[3:5])
    assert before.keys() == after.keys()
    assert not any(base(x) for x in after.values())
    assert all(after[k] == x for k, x in before.items() if not base(x))
    assert sum(bool(base(x)) for x in before.values()) == 3


def test_packing_holds_each_id_once(steps):
    t = library(public_tokenizers.path("byte_bpe_50k.json"))
    want = defaultdict(int)
    for r in steps[4]:
        want[r.doc_id] += len(t.encode(r.text or "", add_special_tokens=False).ids) + 1
    got = defaultdict(int)
    for r in steps[5]:
        got[r.doc_id] += r.length
    assert got == want


def test_run_is_the_stages_in_turn(spark, steps, tmp_path):
    spark.createDataFrame(data(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    # Where documents are cut depends on the partitions they lie in.
    assert {(r.doc_id, r.doc_tokens) for r in P.run(spark, str(tmp_path)).collect()} == {(r.doc_id, r.doc_tokens) for r in steps[5]}


def test_nothing_to_learn_from_rejects_no_letters_only(spark):
    rows = [(i, x, None, "s", 1) for i, x in enumerate(["abc def", "12", None, "é"])]
    got = P.identify_language(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(r.doc_id for r in got) == [0, 3]


def test_phrases_equal_brute_force():
    r = random.Random(4)
    samples = {k: ["".join(r.choice(a) for _ in range(n)) for n in (300, 40)] for k, a in (("aa", "abc d"), ("bb", "bcde f"))}
    model = language.Model(samples)
    texts = ["".join(r.choice("abcdefg h") for _ in range(n)) for n in (0, 1, 90, 500)]
    counts, sizes = model.phrases(texts)

    def joined(x):
        return "".join(map(chr, language.letters(x).tolist()))

    for i, x in enumerate(texts):
        s = joined(x)
        assert sizes[i] == len(s)
        for j, k in enumerate(model.languages):
            corpus = "".join(joined(y) + " " for y in samples[k])
            n, at = 0, 0
            while at < len(s):
                start = at if s[at] in corpus else at + 1  # a letter that is unknown goes with the match behind it
                end = at + 1
                while end < len(s) and s[start : end + 1] in corpus:
                    end += 1
                n, at = n + 1, end
            assert abs(counts[i, j] - n) <= 1, (i, k)  # one more if the first letter is unknown
