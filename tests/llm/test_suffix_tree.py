import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loamgraph.llm import suffix_tree as S
from loamgraph.llm._common import crc32_mod

from .data import frame, rows

END = object()


def words(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")), END]


def brute(data, support, penalty, most):
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in data]
    docs = [words(r[1]) for r in data]
    c = Counter(tuple(d[i : i + k]) for d, h in zip(docs, held) if not h for k in range(1, most + 2) for i in range(len(d) - k + 1))
    n, v = sum(x for g, x in c.items() if len(g) == 1), sum(len(g) == 1 for g in c)
    kept = {g: x for g, x in c.items() if len(g) == 1 or x >= support}
    states, sums = set(), defaultdict(int)
    for g, x in kept.items():
        if len(g) > 1:
            sums[g[:-1]] += x

    def p(s, w):
        if not s:
            return (c[(w,)] + 1) / (n + v + 1)
        if s not in states:
            return p(s[1:], w)
        return (kept.get((*s, w), 0) + (c[s] - sums[s] + 1) * p(s[1:], w)) / (c[s] + 1)

    for depth in range(1, most + 1):
        grams = defaultdict(list)
        for g, x in kept.items():
            if len(g) == depth + 1:
                grams[g[:-1]].append((g[-1], x))
        new = {s for s, g in grams.items() if sum(x * math.log(x / c[s] / p(s[1:], w)) for w, x in g) > penalty * (len(g) + 1)}
        states |= new
    out = []
    for r, h, d in zip(data, held, docs):
        base = sum(math.log10((c[(w,)] + 1) / (n + v + 1)) for w in d)
        out.append((-1 if r[0] is None else r[0], h, len(d), sum(c[(w,)] > 0 for w in d), n, round(base, 6), round(sum(math.log10(p(tuple(d[max(0, i - most) : i]), w)) for i, w in enumerate(d)), 6)))
    return sorted(out), Counter(map(len, states))


def branching():
    """Rows whose next words depend on several words before."""
    import random

    r = random.Random(6)
    out = []
    for i in range(160):
        text = []
        for _ in range(12):
            a, b = r.choice("ab"), r.choice("xy")
            text += [a, b, "mid", "then", (a + b) if r.random() < 0.95 else "noise"]
        out.append((i, " ".join(text)))
    return out


@pytest.mark.parametrize("chars, depth, data", [(6_000_000, 2, rows()), (2000, 5, rows()), (4000, 4, branching()), (2000, 1, branching())])
def test_scores_equal_brute_force(spark, monkeypatch, chars, depth, data):
    monkeypatch.setattr(S, "BLOCK_CHARS", chars)
    docs = spark.createDataFrame([r[:2] for r in data], "doc_id long, text string").repartition(3) if len(data[0]) == 2 else frame(spark)
    got = S.score(docs, crc32_mod("doc_id", 7) == 2, depth=depth).collect()
    want, states = brute(data, S.SUPPORT, S.PENALTY, depth)
    assert states[1] > 5 and (len(data[0]) > 2 or depth < 4 or states[4] > 3)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == want


def test_empty_table(spark):
    assert S.score(frame(spark, True), crc32_mod("doc_id", 7) == 2).collect() == []


def test_grams_that_cannot_be_kept_are_not_sent(spark, monkeypatch):
    import random

    r = random.Random(4)
    data = [(i, " ".join(f"{r.choice('abcdefghij')}{k % 3}" for k in range(30))) for i in range(100)]
    sent, each = [], S._each
    monkeypatch.setattr(S, "_each", lambda blocks, make, schema: (sent.append(each(blocks, make, schema).count()) if schema.startswith("a long, w long, s long") else None, each(blocks, make, schema))[1])
    S.score(spark.createDataFrame(data, "doc_id long, text string").coalesce(1), F.lit(False), depth=2)
    c = Counter(g for _, t in data for w in [words(t)] for g in zip(w, w[1:], w[2:]))
    often = sum(n >= S.SUPPORT for n in c.values())
    assert 0 < sent[0] <= often < len(c) / 2


def test_keys_and_answers_travel_packed():
    import numpy as np
    import pyarrow as pa

    for x in (np.zeros(0, "<u8"), np.array([0, 5, 1 << 63, (1 << 64) - 1], "<u8")):
        assert S._unpacked(S._packed(x), "<u8", len(x)).tolist() == x.tolist()
    keys = np.array([3, 70, 1 << 60, (1 << 63) + 9], np.uint64)
    asked = pa.table([[7], [0], [4], [S._packed(np.diff(keys, prepend=np.uint64(0)))]], names=["block", "part", "n", "keys"])
    model = pa.table([pa.array(keys[[3, 1]].view(np.int64)), [0, 12], [4, 0]], names=["k", "v", "u"])
    got = S._answers(asked, model).to_pylist()[0]
    assert (got["block"], S._unpacked(got["v"], "<i8", 4).tolist(), S._unpacked(got["u"], "<i8", 4).tolist()) == (7, [0, 13, 0, 1], [0, 0, 0, 4])


@pytest.mark.parametrize("resident", [0, 7, 1 << 20])
def test_pairs_and_words_travel_packed_and_others_as_rows(spark, monkeypatch, resident):
    data, sent, each = branching(), [], S._each
    monkeypatch.setattr(S, "RESIDENT", resident)
    monkeypatch.setattr(S, "HELD", 20)
    monkeypatch.setattr(S, "BLOCK_CHARS", 1000)
    monkeypatch.setattr(S, "_each", lambda blocks, make, schema: (sent.append(schema), each(blocks, make, schema))[1])
    got = S.score(spark.createDataFrame(data, "doc_id long, text string").repartition(3), crc32_mod("doc_id", 7) == 2, depth=3).collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == brute(data, S.SUPPORT, S.PENALTY, 3)[0]
    assert ("a long, w long, n long" in sent) == (resident < 1 << 20)
    assert not any(x.startswith("block long, w long") for x in sent)


def test_words_come_back_counted_in_their_order():
    import numpy as np
    import pyarrow as pa

    keys = [np.array(x, np.uint64) for x in ([5, 1 << 63], [], [2, 5, 9])]
    counts = [np.array(x, np.int64) for x in ([1, 4], [], [0, 6, 2])]
    sent = pa.table([[1, 2, 3], pa.array([4] * 3, pa.int32()), [len(k) for k in keys], [S._steps(k) for k in keys], [S._packed(c) for c in counts], [3, 1, 0], [2, 0, 0]], names=["block", "part", "n", "keys", "c", "total", "known"])
    *replies, words = S._words_counted(sent).to_pylist()
    assert [(r["block"], S._unpacked(r["c"], "<i8", r["n"]).tolist(), r["total"]) for r in replies] == [(1, [7, 4], 3), (2, [], 1), (3, [0, 7, 2], 0)]
    assert S._from_steps(words["keys"], words["n"]).tolist() == [2, 5, 9, 1 << 63] and S._unpacked(words["c"], "<i8", 4).tolist() == [0, 7, 2, 4]
    assert (words["block"], words["total"], words["known"]) == (None, 13, 3)


def test_finished_steps_leave_no_shuffle_files(spark):
    import pickle

    import numpy as np

    before = spark.conf.get(S.CLEANUP)
    S.score(frame(spark), crc32_mod("doc_id", 7) == 2, depth=2)
    assert spark.conf.get(S.CLEANUP) == before
    gone = []
    step = S.stored
    try:
        S.stored = lambda df: (gone.append(spark.conf.get(S.CLEANUP)), step(df))[1]
        S.score(frame(spark), crc32_mod("doc_id", 7) == 2, depth=2)
    finally:
        S.stored = step
    assert gone and set(gone) == {"true"}
    entries = S.Entries((np.arange(5, 50_005, dtype=np.uint64) << np.uint64(40), np.arange(50_000), np.arange(50_000) % 7))
    data = pickle.dumps(entries)
    assert len(data) < 12 * 50_000 and all((x == y).all() for x, y in zip(pickle.loads(data), entries))
