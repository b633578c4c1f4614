"""Replays of conversations against a plain walk over each of them."""

import zlib
from collections import defaultdict

import pytest

from loamgraph.llm import replay as R
from loamgraph.llm._common import read

SCHEMA = "conv_id long, turn long, role string, text string, p long, crc long, block long, status string"


def plain(rows):
    """conv_id, turn, status, attempts, first_at, last_at, release_no, state by the definition."""
    out, by_conversation = [], defaultdict(list)
    for conv, turn, text in rows:
        if conv is None or turn is None:
            out.append((conv, turn, *[None] * 6))
        else:
            by_conversation[conv].append((turn, zlib.crc32((text or "").encode())))
    for conv, turns in by_conversation.items():
        made, h = [], lambda k, t: zlib.crc32(f"{k}:{conv}:{t}".encode())
        for p, (turn, crc) in enumerate(sorted(turns)):
            d = h(0, turn) % 7
            parent = made[p - d] if d and p - d >= 0 else None
            if parent and parent[0] != "delivered":
                made.append(("blocked", 0, None, None, turn, crc, p))
                continue
            first = last = max(7 * p, parent[3] if parent else 0)
            attempts, status = 1, "delivered"
            if h(1, turn) % 101 < 20:
                repaired = 7 * p + h(2, turn) % 101
                while last < repaired or h(attempts + 2, turn) % 3 == 0:
                    if attempts == 4:
                        status = "dead"
                        break
                    last += 20 * 2 ** (attempts - 1)
                    attempts += 1
            made.append((status, attempts, first, last, turn, crc, p))
        released, state = {}, 0
        for n, x in enumerate(sorted((x for x in made if x[0] == "delivered"), key=lambda x: (x[3], x[4], x[6])), 1):
            state += n * x[5]
            released[x[6]] = n, (state + (1 << 63)) % (1 << 64) - (1 << 63)
        out += [(conv, x[4], *x[:4], *released.get(x[6], (None, None))) for x in made]
    return out


def key(r):
    return tuple((x is None, x) for x in r)


def check(spark, data, parts=3, **sizes):
    docs = spark.createDataFrame([(c, t, "user", x, 1, 2, 3, "x") for c, t, x in data], SCHEMA).repartition(parts)
    got = R.replay(docs, **sizes)
    assert got.columns == ["conv_id", "turn", "status", "attempts", "first_at", "last_at", "release_no", "state"]
    got = [tuple(r) for r in got.collect()]
    assert sorted(got, key=key) == sorted(plain(data), key=key)
    return got


CASES = [(c, t * 3 - 5, None if t % 11 == 0 else f"text {t % 4} é") for c in (1, 2, -7, 10**15) for t in range(40 + c % 5)]
ODD = [(5, 0, "a"), (5, 0, "b"), (5, 0, "b"), (5, 2, ""), (5, 2, None), (None, 1, "x"), (6, None, "y"), (None, None, None), (8, 3, "only")]


def test_replay_equals_a_plain_walk(spark):
    got = check(spark, CASES + ODD)
    assert {r[2] for r in got} == {"delivered", "dead", "blocked", None}


@pytest.mark.parametrize("block,context", [(16, 7), (16, 0), (64, 20), (5, 30)])
def test_long_conversations_go_by_blocks(spark, block, context):
    hot = [(3, t, f"turn {t % 9}") for t in range(700)]
    check(spark, hot + CASES + ODD, parts=5, block=block, context=context)


def test_states_wrap_around(spark):
    assert [R.wrapped(x) for x in (0, (1 << 63) - 1, 1 << 63, (1 << 64) + 5, -(1 << 63) - 1)] == [0, (1 << 63) - 1, -(1 << 63), 5, (1 << 63) - 1]
    values = [0, 2**63 - 1, 2**63, 2**64 + 5, 10**30]
    rows = spark.sql("SELECT explode(array(" + ",".join(f"CAST('{v}' AS decimal(38,0))" for v in values) + ")) AS x")
    assert [r[0] for r in rows.select(R._long(rows["x"])).collect()] == [R.wrapped(v) for v in values]


def test_an_empty_table(spark):
    check(spark, [])


def test_the_query_equals_a_plain_walk(spark):
    path = "/root/testdata/sf0.01"
    rows = [(r.conv_id, r.turn, r.text) for r in read(spark, path, "conversations").collect()]
    got = [tuple(r) for r in R.op12_replay(spark, path).collect()]
    assert sorted(got, key=key) == sorted(plain(rows), key=key) and len(got) == len(rows)
