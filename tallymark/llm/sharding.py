"""Shards of near equal bytes by minimax contiguous partition.

Equal texts form one atomic group. Groups stand in the order of their hash;
the smallest capacity is sought with which contiguous runs of groups fill at
most the given number of shards. A capacity is checked greedily: every shard
takes groups as long as they fit.

The check needs group sizes only around the cuts. The driver holds sums of
hash intervals; an interval that a cut falls into is split into 256 (one
grouped sum over the groups of those intervals), until the cut lies between
two groups. So a check reads a few hundred sums whatever the number of groups,
and the result is exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.session import materialise

#: Bits of a group's key, of the first intervals, and of one split.
KEY_BITS, FIRST_BITS, SPLIT_BITS = 63, 10, 8
#: Cells per shard for the positions; a cell holds rows of all groups alike.
CELLS = 4096


def text_size(text: str | Column = "text") -> Column:
    """UTF-8 bytes of a text plus 1; a null text has no bytes."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


class _Intervals:
    """Sums of hash intervals in order, refined on demand."""

    def __init__(self, groups: DataFrame):
        self.groups = groups
        first = self._sums(groups, FIRST_BITS)
        self.low = np.array([k << (KEY_BITS - FIRST_BITS) for k, *_ in first], np.int64)
        self.bits = np.full(len(first), FIRST_BITS)
        self.size = np.array([s for _, s, _ in first], np.int64)
        self.lone = np.array([n == 1 for *_, n in first], bool)
        self._prefix()

    @staticmethod
    def _sums(groups: DataFrame, bits: int) -> list[tuple[int, int, int]]:
        part = F.shiftright("key", KEY_BITS - bits)
        return sorted(tuple(r) for r in groups.groupBy(part.alias("part")).agg(F.sum("size"), F.count(F.lit(1))).collect())

    def _prefix(self) -> None:
        self.start = np.concatenate(([0], np.cumsum(self.size)))
        self.total = int(self.start[-1])

    def floor(self, position: int, touched: set[int]) -> int:
        """The last border of groups not behind ``position``, as far as known."""
        if position >= self.total:
            return self.total
        i = int(np.searchsorted(self.start, position, "right")) - 1
        if self.start[i] < position and not self.lone[i]:
            touched.add(i)
        return int(self.start[i])

    def ceiling(self, position: int, touched: set[int]) -> int:
        """The first border of groups not before ``position``, as far as known."""
        i = int(np.searchsorted(self.start, position, "left"))
        if self.start[i] > position and not self.lone[i - 1]:
            touched.add(i - 1)
        return int(self.start[i])

    def refine(self, touched: set[int]) -> None:
        """Split the intervals; one job for each width that occurs."""
        drop, new = np.zeros(len(self.low), bool), []
        for bits in sorted({int(self.bits[i]) for i in touched}):
            at = [i for i in touched if self.bits[i] == bits]
            drop[at] = True
            finer = min(bits + SPLIT_BITS, KEY_BITS)
            parts = [int(self.low[i]) >> (KEY_BITS - bits) for i in at]
            inside = self.groups.where(F.shiftright("key", KEY_BITS - bits).isin(parts))
            new += [(k << (KEY_BITS - finer), finer, s, n == 1) for k, s, n in self._sums(inside, finer)]
        low, bits, size, lone = (np.array(c) for c in zip(*new))
        self.low, self.bits = np.concatenate((self.low[~drop], low)), np.concatenate((self.bits[~drop], bits))
        self.size, self.lone = np.concatenate((self.size[~drop], size)), np.concatenate((self.lone[~drop], lone))
        order = np.argsort(self.low)
        self.low, self.bits, self.size, self.lone = self.low[order], self.bits[order], self.size[order], self.lone[order]
        self._prefix()

    def exactly(self, procedure):
        """Repeat a procedure until every border it used is known."""
        while True:
            touched: set[int] = set()
            result = procedure(touched)
            if not touched:
                return result
            self.refine(touched)

    def key_at(self, border: int) -> int:
        """Least key behind a known border."""
        i = int(np.searchsorted(self.start, border, "left"))
        return int(self.low[i]) if i < len(self.low) else (1 << KEY_BITS) - 1


def _feasible(intervals: _Intervals, capacity: int, shards: int, largest: int) -> bool:
    """Whether greedy filling needs at most ``shards`` shards."""

    def bound(step) -> int:
        at = 0
        for _ in range(shards):
            at = step(at)
        return at

    ignored: set[int] = set()

    def far(at: int) -> int:  # an interval may be cut anywhere, a lone group nowhere
        i = min(int(np.searchsorted(intervals.start, at + capacity, "right")) - 1, len(intervals.size) - 1)
        return int(intervals.start[i]) if intervals.lone[i] and at + capacity < intervals.total else min(at + capacity, intervals.total)

    def near(at: int) -> int:  # an interval may be cut only before it, but less than one group is left over
        return min(intervals.total, max(intervals.floor(at + capacity, ignored), at + capacity - largest + 1))

    if bound(far) < intervals.total:
        return False
    if bound(near) >= intervals.total:
        return True
    return intervals.exactly(lambda touched: bound(lambda at: intervals.floor(at + capacity, touched))) >= intervals.total


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """Smallest capacity, and the keys at which the shards behind the first begin.

    ``groups`` has one row per atomic group with ``key`` (``KEY_BITS`` bits)
    and ``size`` above 0. Among the partitions of that capacity each cut is the
    first border past an even share of the rest, as long as it fits.
    """
    groups = materialise(groups)
    intervals = _Intervals(groups)
    if not intervals.total:
        return 0, [(1 << KEY_BITS) - 1] * (shards - 1)
    largest = groups.agg(F.max("size")).first()[0]
    low = max(largest, -(-intervals.total // shards))
    high = low + largest
    while low < high:
        middle = (low + high) // 2
        if _feasible(intervals, middle, shards, largest):
            high = middle
        else:
            low = middle + 1
    capacity, total = low, intervals.total

    def cut(touched: set[int]) -> list[int]:
        latest = [total]  # the least start from which the rest still fits
        for _ in range(shards - 1):
            latest.append(intervals.ceiling(max(0, latest[-1] - capacity), touched))
        out, at = [], 0
        for left in range(shards, 1, -1):
            even = intervals.ceiling(min(total, at + -(-(total - at) // left)), touched)
            at = even if even - at <= capacity else intervals.floor(at + capacity, touched)
            at = max(at, latest[left - 1])
            out.append(at)
        return out

    borders = intervals.exactly(cut)
    return capacity, [intervals.key_at(b) if b < total else (1 << KEY_BITS) - 1 for b in borders]


def assign(docs: DataFrame, shards: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    All rows of equal text share a shard; null texts are one group. ``slot``
    counts the rows of a shard without gaps. Repeated rows keep a slot each,
    rows without id as well. The texts themselves are not moved.
    """
    rows = materialise(docs.select(
        F.col("doc_id"), text_size().alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64("text"), 64 - KEY_BITS).alias("key")))
    groups = rows.groupBy("key").agg(F.sum("size").alias("size"))
    _, cuts = minimax_cuts(groups, shards)
    shard = sum((F.when(F.col("key") >= F.lit(k), 1).otherwise(0) for k in cuts), F.lit(0)).cast("int")
    placed = rows.select("doc_id", "size", "text_crc32", shard.alias("shard"),
                         F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(CELLS)).cast("int").alias("cell"))
    totals = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("cell")  # at most CELLS rows
    offsets = totals.select("shard", "cell", (F.sum("n").over(before) - F.col("n")).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size"))
    return (placed.withColumn("place", inside).join(F.broadcast(offsets), ["shard", "cell"])  # shards * CELLS rows at most
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("offset") + F.col("place") - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
