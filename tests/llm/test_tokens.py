"""Token files, chunked encoding and packing against the tokenizers library."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loamgraph.llm import chunked_bpe, packing, token_files
from loamgraph.llm._common import shared_dir

from .data import frame, rows

BYTE, WORD = (public_tokenizers.path(f"{x}.json") for x in ("byte_bpe_50k", "word_bpe_49k"))


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def key(r):
    return tuple((x is None, x) for x in r)


def test_elias_fano_selects_every_value():
    for values in ([0], [0, 0, 0], [0, 5, 5, 90], list(range(0, 9000, 7)), [0, *[1 << 33] * 600]):
        ef = token_files.EliasFano.build(np.array(values))
        assert [ef.select(i) for i in range(len(values))] == values
        for i in range(0, len(values), 97):
            k = min(257, len(values) - i)
            assert ef.window(i, k).tolist() == values[i : i + k]


def test_files_hold_the_ids_of_the_library(spark):
    t = library(BYTE)
    docs = [(r[0], t.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in rows()]
    got = token_files.digest(token_files.scan(token_files.write(frame(spark), BYTE, shared_dir(spark), end_id=2))).collect()
    want = [(d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in docs]
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    laid = sorted(got, key=lambda r: (r.start, r.n_tokens))
    assert [r.start for r in laid] == np.cumsum([0, *(r.n_tokens for r in laid)])[:-1].tolist()
    known = [r.doc_id for r in laid if r.doc_id is not None]
    assert known == sorted(known) and laid[0].doc_id is None


def test_files_of_an_empty_table(spark):
    assert token_files.scan(token_files.write(frame(spark, True), BYTE, shared_dir(spark))).collect() == []


@pytest.mark.parametrize("bits", [chunked_bpe.CUT_BITS, 4])
def test_chunks_encode_and_decode_as_the_library(spark, monkeypatch, bits):
    monkeypatch.setattr(chunked_bpe, "CUT_BITS", bits)
    t = library(WORD)
    odd = ["<|endoftext|> a<|startoftext|>b", "é e ́x", "don't 'S it's'll", "a b c\r\nd\x0be", "日本語テキスト" * 40, "x" * 5000 + " y", "1234 5.6,7 !!?? -- ..."]
    texts = [*(r[1] or "" for r in rows()), *odd, " ".join(odd * 20)]
    got = chunked_bpe.ChunkEncoder(WORD, added_tokens=True)
    for x, data in zip(texts, got.encode(texts)):
        want = t.encode(x, add_special_tokens=False).ids
        assert np.frombuffer(data, "<u4").tolist() == want
        assert got.decode(data) == t.decode(want, skip_special_tokens=False)


def test_encoded_rows(spark):
    t = library(WORD)
    got = chunked_bpe.encode(frame(spark), WORD, decoded=True).collect()
    want = []
    for r in rows():
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), t.decode(ids, skip_special_tokens=False)))
    assert sorted(((r.doc_id, r.n_tokens, hashlib.sha256(r.ids).hexdigest(), r.decoded) for r in got), key=key) == sorted(want, key=key)
    assert chunked_bpe.encode(frame(spark, True), WORD).collect() == []


def test_packing_keeps_each_id_once(spark):
    t = library(BYTE)
    data = [r for i, r in enumerate(rows()) if r[0] is not None and r[0] not in {x[0] for x in rows()[:i]}]
    docs = spark.createDataFrame(data, frame(spark, True).schema).repartition(3)
    got = packing.digest(packing.pack(docs, BYTE)).collect()
    ids = {r[0]: t.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in data}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        x = ids[r.doc_id]
        assert r.doc_tokens == len(x)
        assert r.ids_crc32 == zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for d, x in ids.items():
        at = 0
        for start, length in sorted(pieces[d]):
            assert start == at and length > 0
            at += length
        assert at == len(x)
    padded = 0
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
        padded += 0 if at & (at - 1) == 0 else 2048 - at
    assert padded <= 0.02 * sum(map(len, ids.values()))
    assert packing.pack(frame(spark, True), BYTE).collect() == []


def test_documents_go_to_the_cheapest_sequence_with_room():
    lengths = [1000 + 37 * (i * i % 97) % 1000 for i in range(60)] + [30 + i * 13 % 400 for i in range(200)]
    capacity, cut = 2048, 0
    room = [capacity] * (sum(lengths) // capacity) + [1 << i for i in range(12) if (sum(lengths) % capacity) >> i & 1]
    cost = [0.0] * len(room)
    want = []
    for r, d in sorted(zip(lengths, range(len(lengths))), key=lambda x: (-x[0], x[1])):
        while r:
            fit = [(cost[j], -room[j], j) for j in range(len(room)) if room[j] >= r]
            j = min(fit)[2] if fit else min((-room[j], cost[j], j) for j in range(len(room)) if room[j])[2]
            n = min(r, room[j])
            want.append((d, n, j))
            cost[j] += n + n * n / 2048
            room[j] -= n
            r -= n
    assert [(d, n, j) for d, _, n, j, _ in packing.assign(lengths, capacity)] == want


def test_slack_leaves_more_documents_whole():
    lengths = [40 + i * i * 7919 % 1900 for i in range(1500)]
    total = sum(lengths)
    loose, tight = (packing.assign(lengths, 2048, slack=s) for s in (packing.SLACK, 0.0))
    assert len(loose) < len(tight)
    for made in (loose, tight):
        used = {}
        for d, start, n, q, offset in sorted(made, key=lambda x: (x[3], x[4])):
            assert used.get(q, 0) == offset
            used[q] = offset + n
        assert sum(used.values()) == total and max(used.values()) <= 2048
        assert sum(2048 - n for n in used.values() if n & (n - 1)) <= 0.01 * total
        cost = {}
        for _, _, n, q, _ in made:
            cost[q] = cost.get(q, 0) + n + n * n / 2048
    assert len({d for d, *_ in loose}) == len(lengths)


def test_joins_that_disagree_are_encoded_whole(monkeypatch):
    got = chunked_bpe.ChunkEncoder(WORD, added_tokens=True)
    text = " ".join(f"word{i} and" for i in range(400))
    want = np.array(library(WORD).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    monkeypatch.setattr(got, "_words", {"": b"", "and": b"\0\0\0\0"})  # a wrong memo
    assert len(chunked_bpe.cuts(text)) > 3 and got.encode([text]) == [want]


def test_rows_of_one_doc_id_have_an_order(spark):
    docs = spark.createDataFrame([(1, f"text {i % 7} of one id") for i in range(60)] + [(None, f"none {i}") for i in range(9)], "doc_id long, text string")
    runs = [sorted((r.start, r.n_tokens, r.ids_crc32) for r in token_files.digest(token_files.scan(token_files.write(docs.repartition(n), BYTE, shared_dir(spark), end_id=2))).collect()) for n in (2, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == 69


def test_added_tokens_in_texts_are_those_of_the_library(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|ENDOFTEXT|>y <|startoftext|> <|", "plain words", " tail <|endoftext|>\n next", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    byte, word = library(BYTE), library(WORD)
    assert [r.ids for r in chunked_bpe.encode(docs, WORD).orderBy("doc_id").collect()] == [np.array(word.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    want = [(i, zlib.crc32(np.array(byte.encode(x, add_special_tokens=False).ids + [2], "<u4").tobytes())) for i, x in enumerate(texts)]
    got = token_files.digest(token_files.scan(token_files.write(docs, BYTE, shared_dir(spark), end_id=2))).collect()
    assert sorted((r.doc_id, r.ids_crc32) for r in got) == want
    assert 50256 in byte.encode(texts[0], add_special_tokens=False).ids and 49407 in word.encode(texts[0], add_special_tokens=False).ids
