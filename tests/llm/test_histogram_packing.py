"""Packing planned on lengths against plain best-fit decreasing and the tokenizers library."""

import bisect
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from loamgraph.llm import histogram_packing as H
from loamgraph.llm import word_bpe

from .data import frame, rows
from .test_tokens import BYTE, WORD, key, library


def best_fit(lengths, capacity):
    """Sequences that best-fit decreasing opens, a piece at a time."""
    rooms, n = [], 0
    for length in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, length)
        room = rooms.pop(i) if i < len(rooms) else capacity
        n += i == len(rooms) and room == capacity
        bisect.insort(rooms, room - length)
    return n


def laid(slots):
    """(offset, length) of the pieces of each sequence."""
    out = defaultdict(list)
    for length, a, b, k, first, offset in slots:
        for i in range(b - a):
            out[first + i // k].append((offset + i % k * length, length))
    return out


@pytest.mark.parametrize("capacity,n", [(1, 5), (7, 100), (50, 300), (2048, 40), (2048, 4000)])
def test_the_plan_is_best_fit_decreasing(capacity, n):
    r = random.Random(capacity * n)
    for mean in (1, capacity / 10, capacity / 3, capacity):
        lengths = [min(capacity, int(r.expovariate(1 / mean)) + 1) for _ in range(n)]
        made = laid(H.plan(Counter(lengths), capacity))
        assert sorted(made) == list(range(len(made))) and len(made) == best_fit(lengths, capacity)
        assert Counter(x for s in made.values() for _, x in s) == Counter(lengths)
        for s in made.values():
            at = 0
            for offset, length in sorted(s):
                assert offset == at
                at += length
            assert at <= capacity


def test_the_plan_does_not_grow_with_the_counts():
    counts = {n: 1 + n * 7919 % 37 for n in range(1, 2049)}
    small, large = H.plan(counts), H.plan({n: c * 1_000_003 for n, c in counts.items()})
    assert len(large) < 2 * len(small) < 40_000
    assert H.plan({}) == []
    with pytest.raises(ValueError):
        H.plan({0: 1})


def check(spark, docs, data, path, capacity, end):
    got = H.pack(docs, path, capacity, end).collect()
    t = library(path)
    want = []
    for d, x in data:
        ids = t.encode(x or "", add_special_tokens=False).ids + ([] if end is None else [end])
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want.append((d, k // capacity, k, len(part), np.array(part, "<u4").tobytes(), len(ids)))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids, r.doc_tokens) for r in got), key=key) == sorted(want, key=key)
    made = defaultdict(list)
    for r in got:
        made[r.sequence_id].append((r.offset, r.length))
    for s in made.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(made) == best_fit([w[3] for w in want], capacity)


@pytest.mark.parametrize("path,capacity,end", [(WORD, 2048, 0), (WORD, 64, None), (BYTE, 300, 1)])
def test_packed_rows(spark, path, capacity, end):
    check(spark, frame(spark), [(r[0], r[1]) for r in rows()], path, capacity, end)


def test_one_length_in_most_documents_and_one_partition(spark):
    data = [(i, "same text of one length" if i % 3 else f"text {i} " * (i % 11)) for i in range(400)]
    for n in (1, 7):
        check(spark, spark.createDataFrame(data, "doc_id long, text string").repartition(n), data, WORD, 32, 0)


def test_empty_table_and_sequences(spark):
    assert H.pack(frame(spark, True), WORD).collect() == []
    packed = H.pack(frame(spark), WORD, 128)
    by_sequence = defaultdict(list)
    for r in packed.collect():
        by_sequence[r.sequence_id].append((r.offset, r.doc_id, r.ids))
    for r in H.sequences(packed).collect():
        parts = sorted(by_sequence[r.sequence_id], key=lambda x: x[0])
        assert r.ids == b"".join(p[2] for p in parts) and r.doc_ids == [p[1] for p in parts] and r.n_tokens == len(r.ids) // 4


def test_words_encode_as_the_library():
    odd = ["<|endoftext|> a<|startoftext|>b", "é e ́x", "don't 'S it's'll", "a b c\r\nd\x0be", "日本語テキスト" * 40, "x" * 5000 + " y", "1234 5.6,7 !!?? -- ...", "́ ́a", "İ ſ ΑΣ ς", "ªº µ ÀÉ ß, ÄÖ. a.b, c,, d.. .,", "H\u0331 h\u0331 A\u030a", "\x85a\xa0b \x1cc"]
    texts = [*(r[1] or "" for r in rows()), *odd, " ".join(odd * 20)]
    t = library(WORD)
    for x, data in zip(texts, word_bpe.WordEncoder(WORD).encode(texts)):
        assert np.frombuffer(data, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids
    assert isinstance(word_bpe.encoder(public_tokenizers.path("word_bpe_49k.json")), word_bpe.WordEncoder)
