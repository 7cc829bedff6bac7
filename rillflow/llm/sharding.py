"""Sharding by minimax contiguous partition.

Groups (equal texts) are atomic and ordered by a 64-bit hash of their text.  The
smallest shard capacity for which a greedy sweep needs at most ``shards`` shards
is found by binary search; within it, cuts fall where they share out evenly what is
left (a hot group may force the capacity far above the mean).  The driver never sees the groups: it holds a bounded
list of key ranges with their sums.  A search over the ranges as if each were
atomic gives an upper bound on the capacity, the mean and the largest group a
lower one; ranges in which a cut can still fall are refined by another
aggregation, until every one of them is a single group and the answer is exact.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import cut, gapless

#: Key bits of the first ranges (1024 of them), and bits added by each refinement, up to 64.
FIRST_BITS, MORE_BITS = 10, 6


def greedy_cuts(sums: list[int], capacity: int, shards: int) -> list[int] | None:
    """Ends of the shards when each takes as many items as fit, or None if they don't suffice."""
    ends, at = [], 0
    while at < len(sums) - 1:
        to = bisect_right(sums, sums[at] + capacity) - 1
        if to == at or len(ends) == shards:
            return None
        ends.append(to)
        at = to
    return ends


def minimax_capacity(sizes: list[int], shards: int) -> int:
    """The smallest capacity for which ``greedy_cuts`` succeeds."""
    if not sizes:
        return 0
    sums = [0, *accumulate(sizes)]
    lo, hi = max(max(sizes), -(-sums[-1] // shards)), sums[-1]
    while lo < hi:
        mid = (lo + hi) // 2
        if greedy_cuts(sums, mid, shards) is None:
            lo = mid + 1
        else:
            hi = mid
    return lo


def even_cuts(sums: list[int], capacity: int, shards: int) -> list[int]:
    """Ends of shards of at most ``capacity``, each as near as that allows to an even share of what is left.

    What is left after a cut must fit the other shards, which ``greedy_cuts`` tells; its
    own first cut always does, so a feasible capacity stays feasible.
    """
    ends, at = [], 0
    while at < len(sums) - 1:
        left = shards - len(ends)
        most = bisect_right(sums, sums[at] + capacity) - 1
        share = sums[at] + (sums[-1] - sums[at]) / left
        to = min(most, max(at + 1, bisect_right(sums, share) - 1))
        if to < most and sums[to + 1] - share < share - sums[to]:
            to += 1
        fits = lambda end: greedy_cuts([s - sums[end] for s in sums[end:]], capacity, left - 1) is not None
        if not fits(to):
            low = to  # the least later end that leaves enough room
            to = most
            while to - low > 1:
                mid = (low + to) // 2
                low, to = (low, mid) if fits(mid) else (mid, to)
        ends.append(to)
        at = to
    return ends


class Segment(NamedTuple):
    """All groups whose key starts with ``prefix`` (the key's upper ``bits`` bits, signed)."""

    prefix: int
    bits: int
    size: int
    groups: int
    largest: int

    @property
    def start(self) -> int:
        return self.prefix << (64 - self.bits)


def _segments(groups: DataFrame, bits: int, inside: list[Segment] | None = None) -> list[Segment]:
    """Sums by key prefix: 2^bits rows at most, or 2^MORE_BITS for each segment of ``inside``."""
    at = lambda n: F.shiftright("key", 64 - n) if n < 64 else F.col("key")
    if inside is not None:
        wanted = groups.sparkSession.createDataFrame([(s.prefix,) for s in inside], "above long")
        groups = groups.withColumn("above", at(bits - MORE_BITS)).join(F.broadcast(wanted), "above", "left_semi")
    rows = groups.groupBy(at(bits).alias("prefix")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.max("size").alias("largest")).collect()
    return [Segment(r["prefix"], bits, r["size"], r["n"], r["largest"]) for r in rows]


def _uncertain(segments: list[Segment], sums: list[int], lo: int, hi: int, shards: int) -> list[Segment]:
    """Segments of several groups in which a cut can fall for some capacity from lo to hi."""
    found, first, last = set(), 0, 0
    for _ in range(shards):
        first = sums[max(0, bisect_right(sums, first + lo) - 1)]
        last = min(sums[-1], last + hi)
        for i in range(max(0, bisect_right(sums, first) - 1), min(len(segments), bisect_right(sums, last))):
            if segments[i].groups > 1:
                found.add(segments[i])
        if first >= sums[-1]:
            break
    return sorted(found)


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The exact smallest capacity and the keys at which shards 1, 2, ... begin.

    ``groups`` has ``key`` (distinct) and ``size``.  The driver holds some ten
    thousand segments, whatever the number of groups.
    """
    segments = sorted(_segments(groups, FIRST_BITS), key=lambda s: s.start)
    if not segments:
        return 0, []
    while True:
        sizes = [s.size for s in segments]
        sums = [0, *accumulate(sizes)]
        lo = max(max(s.largest for s in segments), -(-sums[-1] // shards))
        hi = max(lo, minimax_capacity(sizes, shards))
        split = _uncertain(segments, sums, lo, hi, shards)
        if not split:
            break
        gone = set(split)
        finer = [s for bits in sorted({s.bits for s in split}) for s in _segments(groups, bits + MORE_BITS, [x for x in split if x.bits == bits])]
        segments = sorted([s for s in segments if s not in gone] + finer, key=lambda s: s.start)
    while lo < hi:
        mid = (lo + hi) // 2
        if greedy_cuts(sums, mid, shards) is None:
            lo = mid + 1
        else:
            hi = mid
    return lo, [segments[i].start for i in even_cuts(sums, lo, shards)[:-1]]


def shard_by_bytes(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, shard, slot``.

    ``size`` is the UTF-8 length of the text (null: 0) plus ``overhead``.  Equal
    texts (null counts as empty) share a shard; texts whose 64-bit hashes collide
    do too.  ``slot`` numbers a shard's rows from 0 without gaps; repeated rows get
    slots of their own.  With fewer groups than shards the last shards stay empty;
    an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text).alias("key"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    groups = cut(rows.groupBy("key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")))
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    _, starts = minimax_cuts(groups, shards)
    shard = sum((F.when(F.col("key") >= F.lit(k), 1).otherwise(0) for k in starts), F.lit(0))
    placed = rows.withColumn("shard", shard.cast("int"))
    return gapless(placed, ["shard"], ["key", "doc_id"], "slot", total).withColumn("slot", F.col("slot").cast("long")).drop("key")
