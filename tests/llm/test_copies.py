"""Near-duplicate documents, repeated bytes and the language of texts against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest

from loamgraph.llm import jaccard, language, repeats
from loamgraph.llm._common import crc32_mod

from .data import frame, rows

DOCS = "doc_id long, text string, lang string, spans string, h string, token string, node long"


def table(spark, texts, lang=None):
    return spark.createDataFrame([(i, x, lang[i] if lang else None, "s", "h", "t", 1) for i, x in enumerate(texts)], DOCS).repartition(4)


def prose(r, n, top=4000):
    return " ".join(f"w{r.randrange(top)}" for _ in range(n))


def near_texts():
    r = random.Random(8)
    out = []
    for _ in range(12):
        base = prose(r, r.choice([6, 30, 150])).split()
        out.append(" ".join(base))
        for _ in range(r.randrange(9)):
            x = list(base)
            for _ in range(r.randrange(4)):
                x[r.randrange(len(x))] = f"W{r.randrange(50)}"
            out.append((" " if r.random() < 0.3 else "\t").join(x))
    line = prose(r, 25)
    return out + [line + " " + prose(r, 20) for _ in range(30)] + [prose(r, 2)] * 3 + ["one two three", "ONE two\nthree", "", None, " \t", "é w1 日本", "é w1 日本"]


def sets(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize("k, percent, group", [(4, 85, 128), (5, 80, 128), (3, 50, 4)])
def test_links_equal_brute_force(spark, monkeypatch, k, percent, group):
    monkeypatch.setattr(jaccard, "GROUP", group)
    texts = near_texts()
    s = [sets(x, k) for x in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and 100 * both >= percent * len(s[i] | s[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    got = jaccard.near_duplicates(table(spark, texts), words=k, percent=percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(i, len(x), c) for i, (x, c) in enumerate(zip(s, label))]
    assert len(set(label)) < len(texts) - 10


def test_near_copies_of_one_text_meet_in_few_groups(spark):
    r = random.Random(1)
    base = prose(r, 80).split()
    texts = []
    for _ in range(400):
        x = list(base)
        x[r.randrange(80)] = f"v{r.randrange(5000)}"  # often with the least shingle, which no other text has
        texts.append(" ".join(x))
    docs = jaccard.documents(table(spark, texts))
    nodes = jaccard._rows(docs, 5, 80).filter("least IS NOT NULL").withColumnRenamed("doc_id", "node")
    cand = jaccard._meeting(nodes.dropDuplicates(["s1", "s2"]).select("node", "s1", "s2", "n", "least", "bucket", "first", "prefix"))
    groups = jaccard._groups(cand, jaccard._near_first(docs, cand, 5, 80))
    assert groups.count() > 300
    assert groups.select("group").distinct().count() <= 12
    assert jaccard._meetings(jaccard._matrix(groups)).count() < 1500


def test_near_duplicates_of_null_ids_and_an_empty_table(spark):
    got = jaccard.near_duplicates(frame(spark)).collect()
    assert len(got) == len(rows()) and [r.component_id for r in got if r.doc_id is None] == [None]
    assert jaccard.near_duplicates(frame(spark, True)).collect() == []


def repeat_texts():
    r = random.Random(5)
    passage, longer = prose(r, 70), prose(r, 200)
    out = [prose(r, r.choice([5, 60, 200])) for _ in range(12)]
    out += [prose(r, r.randrange(60)) + passage + prose(r, r.randrange(60)) for _ in range(8)]
    out += [longer[i * 40 : i * 40 + 700] + prose(r, 30) for i in range(8)]
    out += [out[0], out[3], out[3], longer + " é日 " + longer, "ab" * 900, "a" * 1300, "b" + "a" * 400 + "c", "é" * 300, "x" * 399, "x" * 399, "y" * 401]
    return out + ["", None, prose(r, 90), out[-1] if out[-1] else ""]


def removed(texts, n):
    data = [(x or "").encode() for x in texts]
    seen = Counter(d[i : i + n] for d in data for i in range(len(d) - n + 1))
    out = []
    for i, d in enumerate(data):
        gone = bytearray(len(d))
        for at in range(len(d) - n + 1):
            if seen[d[at : at + n]] > 1:
                gone[at : at + n] = b"\1" * n
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((i, len(d), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("block", [1 << 12, 1 << 14])
def test_anchors_of_pieces_are_those_of_whole_texts(monkeypatch, block):
    r = random.Random(9)
    texts = [prose(r, n).encode() for n in (10, 300, 9000, 40)] + [b"ab" * 9000]

    def found():
        return sorted((x.pieces[o][0], p, h) for x in repeats.anchored(texts, 240) for o, p, h in zip(x.owner.tolist(), (x.at + x.base).tolist(), x.hash.tolist()))

    monkeypatch.setattr(repeats, "BLOCK", 1 << 20)
    whole = found()
    monkeypatch.setattr(repeats, "BLOCK", block)
    assert found() == whole and len(whole) > 500


@pytest.mark.parametrize("length, also, hot", [(400, (240,), 20_000), (100, (), 20_000), (400, (240,), 3), (240, (400,), 1)])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, length, also, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    texts = [*repeat_texts(), "ab" * 2500, prose(random.Random(3), 900), "q" * 4000, *(prose(random.Random(3), 900)[k : k + 2200] for k in (0, 7, 1300))]
    want = removed(texts, length)
    assert sum(x[2] > 0 for x in want) > 15
    got = repeats.remove(table(spark, texts), length, also=also).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got) == want
    for n in also:
        assert sorted((r.doc_id, r[f"covered_{n}"]) for r in got) == [(x[0], x[2]) for x in removed(texts, n)]


def test_repeats_of_odd_and_no_rows(spark):
    assert len(repeats.remove(frame(spark)).collect()) == len(rows())
    assert repeats.remove(frame(spark, True)).collect() == []


def test_languages_of_held_out_texts(spark):
    import zlib

    r = random.Random(2)
    sounds = {"aa": "bakalomi", "bb": "strengvu", "cc": "ouéaxçdl"}
    words = {k: ["".join(r.choice(v) for _ in range(r.randrange(2, 8))) for _ in range(150)] for k, v in sounds.items()}
    lang = [["aa", "bb", "cc", None][i % 4] for i in range(160)]
    texts = [" ".join(r.choice(words[k or "aa"]) for _ in range(60)) for k in lang] + [None, "", "12 34 !", "日本"]
    docs = table(spark, texts, lang + [None] * 4)
    held = crc32_mod("doc_id", 3) == 1
    got = {x.doc_id: x for x in language.identify(docs, docs.filter(~held)).collect()}
    assert sorted(got) == list(range(len(texts)))
    out = [i for i, k in enumerate(lang) if k and zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(out) > 20 and all(got[i].lang_pred == lang[i] for i in out)
    assert [got[i].lang_pred for i in range(160, 163)] == [language.UNDETERMINED] * 3 and got[163].lang_pred in sounds
    assert all(0 <= x.score <= 1 for x in got.values())


@pytest.mark.parametrize("odd", ["123 456", "ok", "OK, merci", "!!", "a"])
def test_a_label_with_hardly_any_text_takes_none(odd):
    r = random.Random(5)
    tongues = {"aa": ["the", "and", "thing", "ing", "on", "water"], "bb": ["der", "und", "keit", "schen", "auf", "wasser"]}
    text = lambda k, n: " ".join(r.choice(tongues[k]) + r.choice(["", "s", "er"]) for _ in range(n))
    samples = {"aa": [text("aa", 60) for _ in range(20)], "bb": [text("bb", 60)], "zz": [odd]}  # unequal as well
    asked = [(k, text(k, 12)) for k in ("aa", "bb") for _ in range(40)]
    got, _ = language.Model(samples).predict([x for _, x in asked])
    assert sum(k == g for (k, _), g in zip(asked, got)) >= 76 and "zz" not in got


def test_sets_are_fetched_only_of_pairs_that_may_be_similar(spark, monkeypatch):
    far = lambda k: list(range(k, k + 5))
    cand = [(1, 20, [*far(100), 7]), (2, 20, [*far(200), 7]), (3, 20, far(300)), (4, 20, [*far(300), 8]), (5, 20, [*far(300), 9])]
    cand = spark.createDataFrame([(i, i, i, n, 3, 18 if i < 5 else 21, 77, p) for i, n, p in cand], "node long, s1 long, s2 long, n long, least long, bucket long, first long, prefix array<int>")
    fetched, with_sets = [], jaccard._with_sets
    monkeypatch.setattr(jaccard, "_with_sets", lambda docs, nodes, words: fetched.extend(r.node for r in nodes.collect()) or with_sets(docs, nodes, words))
    docs = spark.createDataFrame([(i, f"a b c d e{i}") for i in range(6)], "doc_id long, text string")
    jaccard._near_first(docs, cand, 4, 85)
    assert set(fetched) == {3, 4}
