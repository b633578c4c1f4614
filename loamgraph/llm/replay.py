"""Replay of conversations under faults: quarantine of faulty turns, cascading release of those that wait.

The core is a partitioned Python table function: PARTITION BY conversation ORDER BY turn, eval
keeps the outcomes resolved so far, terminate sorts the deliveries and yields releases and
states. So that no conversation has to fit into one task, turns are numbered over range
partitions, and the function's partitions are blocks of ``BLOCK`` turns of a conversation. As
an outcome rests on that of a turn at most ``REACH`` earlier, a block also reads some turns
before it, as context; where a chain of parents reaches further back than the context, the
block is replayed with more of it. Conversations of one block are done then. The deliveries of
longer ones are numbered by time slices, with counts and sums of earlier slices added.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamgraph.llm._common import read, stored
from loamgraph.session import reachable

#: Turns of a block, and those before it that are its context at first.
BLOCK, CONTEXT = 4096, 512
#: Seconds between arrivals; a parent lies less than REACH turns earlier.
STEP, REACH = 7, 7
FAULTY, REPAIR = (20, 101), 101
FIRST_WAIT, ATTEMPTS = 20, 4
DELIVERED, DEAD, BLOCKED, OPEN = "delivered", "dead", "blocked", "open"

OUT = "conv_id long, block long, turns long, p long, turn long, crc long, status string, attempts int, first_at long, last_at long, release_no long, state long"


def chance(k: int, conv_id: int, turn: int) -> int:
    return zlib.crc32(b"%d:%d:%d" % (k, conv_id, turn))


def wrapped(x: int) -> int:
    """As a signed integer of 64 bits."""
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def outcome(conv_id: int, turn: int, p: int, start: int) -> tuple[str, int, int]:
    """Status, attempts and second of the last attempt of a turn whose first attempt is at ``start``."""
    if chance(1, conv_id, turn) % FAULTY[1] >= FAULTY[0]:
        return DELIVERED, 1, start
    repaired = STEP * p + chance(2, conv_id, turn) % REPAIR
    at = start
    for a in range(1, ATTEMPTS + 1):
        if at >= repaired and chance(a + 2, conv_id, turn) % 3:
            return DELIVERED, a, at
        if a < ATTEMPTS:
            at += FIRST_WAIT << a - 1
    return DEAD, ATTEMPTS, at


class Replay:
    """Table function over (conv_id, block, turns, p, turn, crc), PARTITION BY conv_id, block ORDER BY p, and the size of blocks."""

    def __init__(self) -> None:
        self._first: int | None = None
        self._recent: dict[int, tuple[str, int | None]] = {}
        self._rows: list[tuple] = []
        self._head: tuple | None = None

    def eval(self, row, size: int) -> None:
        conv_id, block, turns, p, turn, crc = row
        if self._first is None:
            self._first, self._head = p, (conv_id, block, turns)
        distance = chance(0, conv_id, turn) % REACH
        parent = p - distance
        start: int | None = STEP * p
        status, attempts, first, last = BLOCKED, 0, None, None
        if distance and parent >= 0:
            held, delivered = self._recent[parent] if parent >= self._first else (OPEN, None)
            if held == OPEN:
                status, attempts, start = OPEN, None, None
            else:
                start = max(start, delivered) if held == DELIVERED else None
        if start is not None:
            first = start
            status, attempts, last = outcome(conv_id, turn, p, start)
        self._recent[p] = status, last
        self._recent.pop(p - REACH, None)
        if p >= block * size:
            self._rows.append((p, turn, crc, status, attempts, first, last))

    def terminate(self) -> Iterator[tuple]:
        released: dict[int, tuple[int, int]] = {}
        total = 0
        for n, (_, _, p, crc) in enumerate(sorted((r[6], r[1], r[0], r[2]) for r in self._rows if r[3] == DELIVERED), 1):
            total = wrapped(total + n * crc)
            released[p] = n, total
        for p, turn, crc, status, attempts, first, last in self._rows:
            yield (*self._head, p, turn, crc, status, attempts, first, last, *released.get(p, (None, None)))


def _numbered(turns: DataFrame) -> DataFrame:
    """conv_id, turns, p, turn, crc: turns numbered from 0 by (turn, crc) in their conversation, whatever its size."""
    order = ["conv_id", "turn", "crc", "tie"]
    laid = turns.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    laid = stored(laid.select("conv_id", "turn", "crc", F.monotonically_increasing_id().alias("at"))).withColumn("part", F.shiftright("at", 33))
    heads = laid.groupBy("conv_id", "part").agg(F.min("at").alias("head"), F.count("*").alias("n"))  # a row for each conversation, or for each partition of a long one
    conversation = W.partitionBy("conv_id")
    earlier = F.sum("n").over(conversation.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    heads = heads.select("conv_id", "part", "head", F.coalesce(earlier, F.lit(0)).alias("earlier"), F.sum("n").over(conversation).alias("turns"))
    return laid.join(heads, ["conv_id", "part"]).select("conv_id", "turns", (F.col("at") - F.col("head") + F.col("earlier")).alias("p"), "turn", "crc")


def _replayed(numbered: DataFrame, size: int, context: int, blocks: DataFrame | None = None) -> DataFrame:
    """OUT for all blocks, or those given, with so many turns before each as context; releases count from the block's start."""
    serves = F.sequence(F.expr(f"p div {size}"), F.expr(f"least(p + {context}, turns - 1) div {size}"))
    rows = numbered.select("conv_id", F.explode(serves).alias("block"), "turns", "p", "turn", "crc")
    if blocks is not None:
        rows = rows.join(blocks, ["conv_id", "block"], "left_semi").select("conv_id", "block", "turns", "p", "turn", "crc")
    return F.udtf(Replay, returnType=OUT)(rows.asTable().partitionBy("conv_id", "block").orderBy("p"), F.lit(size))


def _long(x: Column) -> Column:
    """A whole decimal as a signed integer of 64 bits that wraps around."""
    whole = lambda n: F.lit(str(n)).cast("decimal(20,0)")
    m = F.pmod(x, whole(1 << 64))
    return F.when(m >= whole(1 << 63), m - whole(1 << 64)).otherwise(m).cast("long")


def _released(rows: DataFrame, size: int) -> DataFrame:
    """rows with release_no and state over all blocks of a conversation: by slices of time, each about as large as a block."""
    whole = lambda c: F.col(c).cast("decimal(20,0)")
    by_time = W.partitionBy("conv_id", "slice").orderBy("last_at", "turn", "p").rowsBetween(W.unboundedPreceding, 0)
    delivered = rows.filter(F.col("status") == DELIVERED).withColumn("slice", F.expr(f"last_at div {STEP * size}"))
    local = delivered.withColumn("n", F.count("*").over(by_time)).withColumn("c", F.sum(whole("crc")).over(by_time)).withColumn("s", F.sum(whole("n") * whole("crc")).over(by_time))
    slices = local.groupBy("conv_id", "slice").agg(F.max("n").alias("n"), F.max("c").alias("c"), F.max("s").alias("s"))
    earlier = W.partitionBy("conv_id").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)  # a row for each block's worth of turns
    zero = F.lit(0).cast("decimal(38,0)")
    slices = slices.withColumn("n0", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    slices = slices.withColumn("s0", F.coalesce(F.sum(whole("n0") * F.col("c") + F.col("s")).over(earlier), zero)).select("conv_id", "slice", "n0", "s0")
    made = local.drop("release_no", "state").join(slices, ["conv_id", "slice"])
    made = made.withColumn("release_no", F.col("n") + F.col("n0")).withColumn("state", _long(F.col("s0") + whole("n0") * F.col("c") + F.col("s")))
    return made.select(*rows.columns).unionByName(rows.filter(F.col("status") != DELIVERED))


def replay(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", text: str = "text", block: int = BLOCK, context: int = CONTEXT) -> DataFrame:
    """conv_id, turn, status (delivered, dead, blocked), attempts, first_at, last_at, release_no, state of every turn.

    A null text is empty. Rows without a conversation or a turn take no part in the replay and
    come back with nulls. Rows that repeat a turn are turns one after the other, ordered by the
    crc32 of their texts, with equal chances; equal rows cannot be told apart. A state beyond 64
    bits wraps around. Other columns are dropped, an empty table gives no rows.
    """
    reachable(turns.sparkSession)
    rows = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("crc"))
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    numbered = stored(_numbered(rows.filter(known)))
    longest = numbered.agg(F.max("turns")).first()[0] or 0
    out = _replayed(numbered, block, context)
    if longest > block:
        out = stored(out)
        while not (missing := out.filter(F.col("status") == OPEN)).isEmpty():
            context = 16 * max(context, 1)
            blocks = missing.select("conv_id", "block").distinct()
            out = stored(out.join(blocks, ["conv_id", "block"], "left_anti").unionByName(_replayed(numbered, block, context, blocks)))
        out = out.filter(F.col("turns") <= block).unionByName(_released(out.filter(F.col("turns") > block), block))
    columns = ["status", "attempts", "first_at", "last_at", "release_no", "state"]
    unknown = rows.filter(~known).select("conv_id", "turn", *[F.lit(None).cast(out.schema[c].dataType).alias(c) for c in columns])
    return out.select("conv_id", "turn", *columns).unionByName(unknown)


def op12_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(read(spark, sf_dir, "conversations"))
